from cratewright.operators import stages


def test_every_deck_and_session(spark):
    tracks = spark.createDataFrame([(i, f"/t{i}", f"Artist {i:02}", f"Title {i:02}") for i in range(40)], "idx int, path string, artist string, title string")
    shown = spark.createDataFrame([(f"deck {i:02}", f"artist {i:02}", f"TITLE {i:02}") for i in range(40) for _ in range(3)], "deck string, artist string, title string")
    got = {r.deck: r.path for r in stages.now_playing(shown, tracks).collect()}
    assert got == {f"deck {i:02}": f"/t{i}" for i in range(40)}

from cratewright.llm import canon


def test_three_letters_of_a_four_letter_entry():
    d = canon.Dictionary([(1, "Funk", [], 0), (2, "Soul", [], 0), (3, "Folk", [], 0), (4, "Pop", [], 0)])
    assert [d.nearest(w)[2] for w in ("unk", "sol", "fol", "pop")] == [1, 2, 3, 4]
    assert all(d.nearest(w)[0] == 99.0 for w in ("pip", "133", "tbd", "fu", ""))


def test_names_cut_short_come_after_slips():
    d = canon.Dictionary([(1, "Punk Rock", [], 0), (2, "Krautrock", [], 0), (3, "Swing", [], 0), (4, "Singer-Songwriter", [], 0), (5, "Techno", [], 0), (6, "Tech House", [], 0), (7, "Drum and Bass", ["dnb"], 0)])
    assert [d.lookup(v) for v in ("punk", "kraut", "Sing", "minimal techno", "d&b", "drum n bass", "house of cards")] == [1, 2, 3, 5, 7, 7, 0]

"""Queries over the whole job that SQL cannot express, against brute force."""

import html
import re
import unicodedata

from cratewright.plans import collection_queries, registry


def test_sanitize_titles(spark, tmp_path):
    titles = ["plain / x", "Ｗｉｄｅ: ﬁne", "é é", "Мир", "…", " . ", "", "½__ x", "長" * 120, None]
    spark.createDataFrame(list(enumerate(titles)), "entry_id bigint, title string").write.parquet(f"{tmp_path}/nml_entry.parquet")

    def brute(t):
        s = unicodedata.normalize("NFKC", t.strip(" "))
        s = re.sub("[ _]{2,}", " ", re.sub(r'[\\/:*?"<>|]', "_", s)).strip(" ._")
        return s[:100] or "Unknown"

    got = {r.entry_id: r.name for r in registry.queries()["sanitize_name"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(titles) if t is not None}


def test_html_texts(spark, tmp_path):
    texts = ["a<br>b<BR />c", "<style>p {x}</style>a<script type='x'>if (1 < 2) {}</script>b", "x &amp; y &lt;b&gt; &#65; &nope;", "<p\nclass=x>text</p> 1 < 2", "plain", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(t):
        t = re.sub(r"<br\s*/?>", "\n", t, flags=re.I)
        t = re.sub(r"<(script|style)\b.*?</\1>", "", t, flags=re.I | re.S)
        return html.unescape(re.sub(r"<[^>]*>", "", t))

    got = {r.doc_id: r.plain for r in registry.queries()["html_strip"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts) if t is not None}


def test_rebuild_refs(spark, tmp_path):
    def path(i):
        return [r.path for r in at if r.entry_id == i][0]

    entries = [(1, "/:crates/:main/:", "a.mp3", 1), (2, "/:crates/:inbox/:", "b.mp3", 2), (3, "/:crates/:else/:", "c.mp3", 0), (4, "/:crates/:main/:", "d.mp3", 0)]
    rows = [(i, d, f, "", [("c",)] * n) for i, d, f, n in entries]
    spark.createDataFrame(rows, "entry_id bigint, loc_dir string, loc_file string, loc_volume string, cues array<struct<cue_name: string>>").write.parquet(f"{tmp_path}/nml_entry.parquet")
    spark.createDataFrame([(1, 1, "s"), (1, 2, "s")], "group_id bigint, entry_id bigint, sha string").write.parquet(f"{tmp_path}/dedup_member.parquet")
    spark.createDataFrame([(n, 7, n) for n in (1, 2, 3, 4)], "row_id bigint, session_id bigint, entry_id bigint").write.parquet(f"{tmp_path}/history_row.parquet")
    at = collection_queries.entry_paths(spark, str(tmp_path)).select("entry_id", "path").collect()
    music = {i: "/music" + path(i)[12:] for i in (1, 4)}
    run = registry.queries()
    assert sorted((r.playlist, r.pos, r.path) for r in run["rebuild_refs"](spark, str(tmp_path)).collect()) == [("7", 1, music[1]), ("7", 2, music[1]), ("7", 4, music[4])]
    assert sorted((r.entry_idx, r.path) for r in run["rebuild_kept"](spark, str(tmp_path)).collect()) == [(2, music[1]), (4, music[4])]

"""Spans against plain loops and against extraction's own arbitration."""

import random

from pyspark.sql import functions as F

from lumenspan.functions.answers import KINDS, Matcher
from lumenspan.operators.extraction import united_evidence
from lumenspan.operators import readmodel
from lumenspan.operators.readmodel import page_of, written_blocks, written_pages
from lumenspan.operators.spans import BIN, clear_of, segments, settled
from lumenspan.sources.payloads import sniffed

SPAN = "key long, who int, id string, kind string, rank int, start int, end int, seq int"


def meets(a, b):
    return a[0] < b[1] and b[0] < a[1]


def test_spans_clear_of_others(spark):
    rng = random.Random(6)
    span = lambda: (lambda a: (rng.randrange(4), a, a + rng.choice([1, 3, 9, BIN, 3 * BIN])))(rng.randrange(1000))
    mine, others = [span() for _ in range(300)], [span() for _ in range(15)]
    frame = lambda rows: spark.createDataFrame(rows, "key long, start int, end int")
    found = clear_of(frame(mine), frame(others), ["key"])
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    want = [s for s in mine if not any(o[0] == s[0] and meets(s[1:], o[1:]) for o in others)]
    assert sorted(map(tuple, found.collect())) == sorted(want) and 0 < len(want) < len(mine)


def test_columns_settle_what_extraction_settles(spark):
    """v2 within each entity, v3 across all, spelled names before near ones."""
    rng = random.Random(8)
    names = ["acme", "acme cloud", "cloud", "cloud nine", "nine", "acmes", "globex", "globex nine"]
    entities = [{"id": f"e{i}", "kind": "BRAND", "name": n, "aliases": rng.sample(names, 2), "domain": f"{n.split()[0]}.com"} for i, n in enumerate(names)]
    matcher, rows, want = Matcher(entities), [], {"v2": [], "v3": []}
    for key in range(80):
        text = " ".join(rng.choice([*names, "acne", "cloude", "globe", "nine.", "acme.com", "and"]) for _ in range(rng.randrange(30)))
        found = matcher.spans(text)
        rows += [(key, s.who, entities[s.who]["id"], s.kind, KINDS[s.kind][0], s.start, s.end, n) for n, s in enumerate(found)]
        for version in want:
            want[version] += [(key, s.who, s.kind, s.start, s.end) for s in matcher.settled(list(found), version)]
    spans = spark.createDataFrame(rows, SPAN)
    shown = lambda df: sorted((r.key, r.who, r.kind, r.start, r.end) for r in df.collect())
    assert shown(settled(spans, ["key", "who"], [F.col("rank"), F.col("start"), F.col("seq")])) == sorted(want["v2"])
    near, spelled = spans.where("kind = 'APPROXIMATE'"), spans.where("kind <> 'APPROXIMATE'")
    left = spelled.unionByName(clear_of(near, spelled, ["key"]))
    assert shown(settled(left, ["key"], [F.col("rank"), F.col("start") - F.col("end"), F.col("id"), F.col("start"), F.col("seq")])) == sorted(want["v3"])


def test_segments_are_cut_in_utf_16_units(spark):
    cases = [("ab😀cd", [(2, 4), (3, 6)]), ("abc", []), ("", [(0, 1)]), ("abcdef", [(1, 3), (1, 5), (4, 6), (2, 2)]), ("é😀", [(0, 1), (1, 3)])]
    df = spark.createDataFrame(cases, "t string, s array<struct<start:int,end:int>>")
    got = [[(p.text, p.marked) for p in r.p] for r in df.select(segments(F.col("t"), F.col("s")).alias("p")).collect()]
    assert got == [[("ab", False), ("😀", True), ("cd", False)], [("abc", False)], [], [("a", False), ("bcde", True), ("f", False)], [("é", True), ("😀", True)]]


def test_vendors_are_told_by_shape(spark):
    bodies = {
        '{"output": [{"content": [{"annotations": [{"type": "url_citation", "url": "https://a.com", "title": "t"}, {"type": "other", "url": "https://b.com"}]}]}]}': ("openai", ["https://a.com"], None),
        '{"content": [{"type": "text", "citations": [{"url": "https://c.com", "title": null}]}, {"type": "web_search_tool_result", "content": [{"url": "https://d.com"}]}]}': ("claude", ["https://c.com", "https://d.com"], None),
        '{"candidates": [{"groundingMetadata": {"groundingChunks": [{"web": {"uri": "https://e.com"}}]}}]}': ("gemini", ["https://e.com"], None),
        '{"citations": ["https://f.com", "https://f.com"]}': ("perplexity", ["https://f.com"], None), '{"choices": []}': ("perplexity", [], None), '{"output": []}': ("openai", [], None),
        "{": (None, None, "malformed"), '{"a": [1]}': (None, None, "unknown shape OBJECT<a: ARRAY<BIGINT>>"), "null": (None, None, "unknown shape VOID"),
    }
    df = spark.createDataFrame([(b,) for b in [*bodies, None]], "payload string")
    got = {r.payload: (r.vendor, None if r.sources is None else [s.url for s in r.sources], r.fault) for r in sniffed(df).collect()}
    assert got == {**bodies, None: (None, None, "malformed")}


def test_a_page_reads_its_block_alone(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i % 3}", i) for i in range(300)], "run_id string, n long")
    written_pages(rows, "run_id", [F.desc("n")], str(tmp_path / "p"), 10)
    page = page_of(spark, str(tmp_path / "p"), "n long, place int, run_id string, page int", "run_id", "r1", 3)
    assert [r.n for r in page.collect()] == [x for x in range(299, -1, -1) if x % 3 == 1][30:40]
    assert all("run_id=r1/page=3/" in f for f in page.select("_metadata.file_path").distinct().toPandas().file_path)
    assert "PartitionFilters: [isnotnull(run_id" in page._jdf.queryExecution().toString()


def test_many_pages_are_few_files(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"r{i % 3}", i) for i in range(6000)], "run_id string, n long")
    written_blocks(rows, "run_id", [F.desc("n")], str(tmp_path / "p"), 10)
    page = page_of(spark, str(tmp_path / "p"), "n long, place int, run_id string, page int", "run_id", "r1", 3)
    assert [r.n for r in page.collect()] == [x for x in range(5999, -1, -1) if x % 3 == 1][30:40]
    assert "EqualTo(page,3)" in page._jdf.queryExecution().toString()
    monkeypatch.setattr(readmodel, "new_path", lambda spark, name: str(tmp_path / name))
    assert readmodel.task_page(spark, "/root/testdata/sf0.001").count() > 0
    # 600 pages, and those of the query: no folder or file for each
    for name in ("p", "task-pages"):
        assert len(list((tmp_path / name).rglob("*.parquet"))) <= 4


def test_stored_evidence_stays_as_it_is(spark):
    answers = spark.createDataFrame([(1, "inble and antion"), (2, "inble"), (3, "nothing"), (4, "thtion inble")], "sample_id long, text string")
    fresh = united_evidence(answers, united_evidence(answers.where("false"), _none(spark)).drop("origin"))
    assert {(r.sample_id, r.entity_id, r.origin) for r in fresh.collect()} == {(1, "b1", "fresh"), (1, "c1", "fresh"), (2, "b1", "fresh"), (4, "c2", "fresh"), (4, "b1", "fresh")}
    stored = _none(spark).unionByName(spark.createDataFrame([(1, "old"), (3, None)], "sample_id long, entity_id string"), allowMissingColumns=True)
    got = {(r.sample_id, r.entity_id, r.origin) for r in united_evidence(answers, stored).collect()}
    assert got == {(1, "old", "stored"), (2, "b1", "fresh"), (4, "c2", "fresh"), (4, "b1", "fresh")}


def _none(spark):
    from lumenspan.operators.extraction import mention_rows

    return mention_rows(spark.createDataFrame([], "sample_id long, text string"))

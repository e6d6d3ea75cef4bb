import pytest
from pyspark.sql import functions as F

from lumenspan.functions.answers import Matcher, context, extracted, one_edit, sentence_starts
from lumenspan.functions.urls import ascii_url, in_locale, normalized_url, registrable_domain, same_domain, text_urls
from lumenspan.operators.rules import scored
from lumenspan.operators.sources_report import merged_citations
from lumenspan.sources.payloads import merged_sources, native_sources, truncated
from lumenspan.sources.passport import passport_document, passports, run_passports
from lumenspan.sources.sinks import csv_header, csv_lines, passport_filename, passport_markdown, replace_partitions, safe_filename, upsert, write_csv


def brand(name, aliases=(), domain=None, id="b", kind="BRAND"):
    return {"id": id, "kind": kind, "name": name, "aliases": list(aliases), "domain": domain}


def found(text, *entities, version="v3"):
    return [(m[0], m[2], m[4]) for m in Matcher(list(entities)).mentions(text, version)]


def test_case_accents_and_offsets():
    assert found("Un cafe.", brand("Café")) == [("b", "EXACT", 3)]
    assert found("Un Café.", brand("cafe")) == [("b", "EXACT", 3)]
    assert found("Un café noir", brand("Café")) == [("b", "EXACT", 3)]
    assert found("a😀 Acme", brand("Acme")) == [("b", "EXACT", 4)]


@pytest.mark.parametrize("text", ["Acmeville", "Acme2", "superAcme"])
def test_only_whole_words(text):
    assert found(text, brand("Acme")) == []


@pytest.mark.parametrize("name", ["C#", ".NET", "Node.js"])
def test_names_with_signs(name):
    assert found(f"We use {name}, often", brand(name)) == [("b", "EXACT", 7)]


def test_near_spellings():
    assert found("I like Notin.", brand("Notion")) == [("b", "APPROXIMATE", 7)]
    assert found("I like Nti.", brand("Notion")) == found("I like Acmo.", brand("Acme")) == []
    assert found("zohocrm", brand("Zoho CRM")) == [("b", "APPROXIMATE", 0)]
    assert one_edit("abc", "abc") and one_edit("abc", "abdc") and one_edit("", "a") and not one_edit("abcd", "abdc")


def test_spans_are_settled_across_entities():
    figma, sigma = brand("Figma"), brand("Sigma", id="c", kind="COMPETITOR")
    assert found("Sigma leads", figma, sigma) == [("c", "EXACT", 0)]
    assert found("Sigma leads", figma, sigma, version="v2") == [("b", "APPROXIMATE", 0), ("c", "EXACT", 0)]
    rival = brand("Acme Rival", id="c", kind="COMPETITOR")
    assert found("Acme Rival beats Acme", brand("Acme"), rival) == [("c", "EXACT", 0), ("b", "EXACT", 17)]
    assert found("Twin", brand("Twin", id="z"), brand("Twin", id="a")) == [("a", "EXACT", 0)]
    assert found("see www.acme.com/x", brand("Nope", domain="https://www.acme.com/y")) == [("b", "DOMAIN", 8)]


def test_sentences():
    assert sentence_starts("M. Dupont is here. He left.") == [0, 19]
    assert sentence_starts("") == [0] and sentence_starts("One long sentence. ") == [0]


def plain_spans(text, entities):
    """Every place of every needle, character by character."""
    import unicodedata

    folded, origin = [], []
    for i, c in enumerate(text):
        for x in "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M")).lower():
            folded.append(x)
            origin.append(i)
    origin.append(len(text))
    letter = lambda k: 0 <= k < len(folded) and unicodedata.category(folded[k])[0] in "LN"
    out = set()
    for who, e in enumerate(entities):
        for kind, needle in [("EXACT", e["name"]), *(("ALIAS", a) for a in e["aliases"])]:
            n = list(needle.lower())
            for k in range(len(folded) - len(n) + 1):
                if folded[k : k + len(n)] == n and not letter(k - 1) and not letter(k + len(n)):
                    out.add((kind, origin[k], origin[k + len(n)], who))
        k = 0
        while k < len(folded):
            end = k
            while letter(end):
                end += 1
            if end > k and len(e["name"]) >= 5 and one_edit("".join(folded[k:end]), e["name"].lower()):
                out.add(("APPROXIMATE", origin[k], origin[end], who))
            k = max(end, k + 1)
    return out


def test_spans_against_plain_search():
    import random

    rng = random.Random(2)
    entities = [brand("Notion", ["nt"]), brand("Motion", id="c"), brand("Zed", id="d")]
    pieces = ["notion", "Nótion", "motions", "notin", "NT", "zed", "Zéd", "İ", "ﬁn", "😀", "über", " ", ". ", "-", "x", "ntion"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 14)))
        got = Matcher(entities).spans(text)
        assert {(s.kind, s.start, s.end, s.who) for s in got} == plain_spans(text, entities)


def test_context_counts_utf_16_units():
    assert context("😀" * 60 + "Acme" + "😀" * 60, 60, 64) == "…" + "😀" * 50 + "Acme" + "😀" * 50 + "…"
    assert context("a" + "😀" * 50 + "b Acme", 53, 57) == "…" + "😀" * 49 + "b Acme"
    assert context("x" * 120 + " Acme  y", 121, 125) == "…" + "x" * 99 + " Acme y"


def test_extraction_keeps_rows_without_mentions(spark):
    df = spark.createDataFrame([(1, "Acme. " * 3), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.mentions for r in extracted(df, [brand("Acme")]).collect()}
    assert [m.occurrence_index for m in got[1]] == [0, 1, 2] and got[1][0].occurrences_total == 3 and got[1][0].in_first_sentence
    assert got[2] == got[3] == []
    with pytest.raises(ValueError):
        extracted(df, [], version="v9")


URLS = {
    "https://Example.com/search?q=crm&page=2&id=7": "example.com/search?id=7&page=2&q=crm",
    "www.example.com/a/": "example.com/a", "http://example.com:8080/A#x": "example.com/a", "https://u:p@www.example.co.uk/?utm_source=x": "example.co.uk",
    "https://example.com/a/./b/../c": "example.com/a/c", "https://example.com/../x/%2E%2e/y/": "example.com/y", "https://example.com/a b/é": "example.com/a%20b/%c3%a9",
    "https://example.com/a?q=two+words&%69d=3&Q=x%20y": "example.com/a?id=3&q=two words&q=x y", "https://example.com/?id=%zz+1": "example.com/?id=%zz 1".replace("/?", "?"),
    "https://example.com\\a\\b": "example.com/a/b", "https://example.com/..": "example.com", "https://example.com/%7Euser": "example.com/%7euser",
    "localhost": None, "http://10.0.0.1/": None, "ftp://example.com": None, "mailto:a@example.com": None, " ": None, "not a url": None,
}


def test_domains_from_the_grammar_of_addresses(spark):
    asked = {"www.shop.example.co.uk": "example.co.uk", "HTTP://user:pw@a.b.example.com:80/x?y": "example.com", "..example.org..": "example.org", "example.com#f": "example.com", "": "", "com": "com", "http://": ""}
    df = spark.createDataFrame(list(asked.items()), "x string, want string")
    assert {r.x: r.got for r in df.select("x", registrable_domain(df.x).alias("got")).collect()} == asked


def test_normal_addresses(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    assert {r.u: r.n for r in df.select("u", normalized_url(F.col("u")).alias("n")).collect()} == URLS


def test_sentences_as_columns(spark):
    from lumenspan.operators.evidence import sentences

    texts = ["", "One.", "One. Two.", "A first sentence here. And a second one! ", "Short. Yes. No. A longer end follows here. x", "Dr. Who went. Home… at last?  Yes\nno. "] + ["A b. " * n for n in range(9)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(sentences(F.col("t")).alias("n")).collect()] == [len(sentence_starts(t)) for t in texts]


def test_hosts_beyond_ascii(spark):
    asked = {
        "https://www.Bücher.de/Straße?q=1": "xn--bcher-kva.de/stra%c3%9fe?q=1", "MÜNCHEN.example.com": "xn--mnchen-3ya.example.com", "http://u:p@例え.jp:80/": "xn--r8jz45g.jp",
        "ｅｘａｍｐｌｅ。com/a": "example.com/a", "https://faß.de": "xn--fa-hia.de", "https://пример.рф/": None, "https://example.com/é": "example.com/%c3%a9", "école": None, "é": None, "": None,
        "https://a-.com": None, "https://-a.com": None, "https://a..com": None, "https://a.c": None, "https://a.b1": None, "https://a_b.com": None, "x-y.z9.org": "x-y.z9.org",
    }
    df = spark.createDataFrame([(u,) for u in [*asked, None]], "u string")
    assert {r.u: r.n for r in df.select("u", normalized_url(ascii_url(F.col("u"))).alias("n")).collect()} == {**asked, None: None}


def test_order_of_a_locale(spark):
    df = spark.createDataFrame([(x,) for x in ("Zoé", "zeta", "Émile", "Eclair", "eclair", "étude", "10", "_a")], "x string")
    assert [r.x for r in df.orderBy(in_locale(F.col("x"))).collect()] == ["_a", "10", "eclair", "Eclair", "Émile", "étude", "zeta", "Zoé"]
    two = spark.createDataFrame([("https://example.com/?q=b&q=B&q=a&q=%C3%A9&q=z",)], "u string")
    assert two.select(normalized_url(F.col("u"))).first()[0] == "example.com?q=a&q=b&q=b&q=é&q=z"


def test_domains(spark):
    hosts = {"shop.example.co.uk": "example.co.uk", "user@blog.example.com": "example.com", "example.com:8443": "example.com", "https://www.a.b.example.org/x": "example.org", "": ""}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: r.d for r in df.select("h", registrable_domain(F.col("h")).alias("d")).collect()} == hosts
    pairs = [("acme.com", True), ("blog.acme.com", True), ("acme.competitor.com", False), ("notacme.com", False), ("", False)]
    df = spark.createDataFrame(pairs, "h string, want boolean")
    assert all(r.same == r.want for r in df.withColumn("same", same_domain(F.col("h"), F.lit("acme.com"))).collect())


def test_links_in_text(spark):
    text = "[A](https://a.com/x) and https://a.com/x, https://b.com. [](http://c.com)"
    got = spark.createDataFrame([(text,)], "t string").select(text_urls(F.col("t")).alias("s")).first().s
    assert [(s.url, s.title, s.kind) for s in got] == [("https://a.com/x", "A", "INLINE_MARKDOWN"), ("http://c.com", None, "INLINE_MARKDOWN"), ("https://b.com", None, "BARE_URL")]


def test_citations_merge_by_strength(spark):
    rows = [("s", 0, "https://a.com/x?utm_source=1", None, "BARE_URL"), ("s", 1, "https://b.com", "B", "NATIVE"), ("s", 2, "https://a.com/x", "T", "NATIVE"), ("s", 3, "https://a.com/x/", "late", "NATIVE"), ("s", 4, "nonsense", "x", "NATIVE")]
    df = spark.createDataFrame(rows, "sample_id string, at int, url string, title string, source_kind string")
    got = {r.normalized: (r.url, r.title, r.source_kind, r.position) for r in merged_citations(df, ["sample_id"]).collect()}
    assert got == {"a.com/x": ("https://a.com/x", "T", "NATIVE", 1), "b.com": ("https://b.com", "B", "NATIVE", 2)}


def test_payloads(spark):
    one = lambda engine, p: [(s.url, s.title) for s in spark.createDataFrame([(p,)], "p string").select(native_sources(engine, F.col("p")).alias("s")).first().s]
    assert one("openai", '{"output":[{"content":[{"annotations":[{"type":"url_citation","url":"u","title":"a"},{"type":"other","url":"v"},{"type":"url_citation","url":"u","title":"b"}]}]}]}') == [("u", "b")]
    assert one("perplexity", '{"citations":["u",""]}') == [("u", None)]
    assert one("claude", '{"content":[{"type":"text","citations":[{"url":"u","title":"t"}]},{"type":"web_search_tool_result","content":[{"url":"v","title":"w"}]}]}') == [("u", "t"), ("v", "w")]
    assert one("gemini", '{"candidates":[{"groundingMetadata":{"groundingChunks":[{"web":{"uri":"u","title":"t"}}]}}]}') == [("u", "t")]
    assert one("mock", '{"sources":["u"]}') == [("u", None)]
    with pytest.raises(Exception, match="no openai payload"):
        one("openai", "{}")
    kinds = spark.range(1).select(merged_sources(F.array(F.struct(F.lit("https://a.com").alias("url"), F.lit(None).cast("string").alias("title"), F.lit("NATIVE").alias("kind"))), F.lit("https://a.com https://b.com")).alias("s")).first().s
    assert [k.kind for k in kinds] == ["NATIVE", "BARE_URL"]
    assert spark.range(1).select(truncated("gemini", F.lit("MAX_TOKENS"))).first()[0]


MENTION = "array<struct<entity_id:string,kind:string,mention_type:string,char_offset:int,normalized_position:double,in_first_sentence:boolean,order_rank:int,sentiment:string>>"


def score(spark, mentions, citations=(), mode="PARAMETRIC", version="v3"):
    df = spark.createDataFrame([(mode, mentions, list(citations))], f"mode string, mentions {MENTION}, citations array<struct<source_kind:string,is_brand_domain:boolean>>")
    return scored(df, version).first()


def hit(n=1, kind="EXACT", sentiment=None):
    return [("b", "BRAND", kind, 40 * i, 40 * i / 600, i == 0, 0, sentiment) for i in range(n)]


def rivals(n, rank=1):
    return [(f"c{i}", "COMPETITOR", "EXACT", 300 + 10 * i, 0.5, False, rank + i, None) for i in range(n)]


def test_score_by_hand(spark):
    import math

    s = score(spark, hit())
    assert s.score == pytest.approx(1.1875 * (35 + 15 + 10 * math.log(2) / math.log(6) + 20 * 2 / 3))
    assert sum(c.contribution for c in s.contributions) == pytest.approx(s.score)
    assert [c.redistributed for c in s.contributions] == [True] * 4 + [False] * 3


def test_absence_and_rivals(spark):
    s = score(spark, rivals(4))
    assert s.share_of_voice == pytest.approx(1 / 6) and not s.brand_present and s.brand_order_rank is None and s.score == 0
    fuzzy = score(spark, hit(kind="APPROXIMATE"))
    assert not fuzzy.brand_present and fuzzy.brand_order_rank is None and not any(c.redistributed for c in fuzzy.contributions)
    assert score(spark, hit(kind="APPROXIMATE"), version="v2").brand_present
    led = score(spark, [*[("b", "BRAND", "EXACT", 90, 0.1, False, 2, None)], *rivals(2, 0)])
    assert {c.rule_id: c.contribution for c in led.contributions}["competitorLead"] == -8


def test_frequency_citations_sentiment(spark):
    rule = lambda s, r: next(c for c in s.contributions if c.rule_id == r)
    assert rule(score(spark, hit(5)), "frequency").raw_value == rule(score(spark, hit(10)), "frequency").raw_value == 1
    typed = score(spark, hit(), [("BARE_URL", True)], "GROUNDED")
    assert typed.score == score(spark, hit()).score and not typed.brand_domain_cited
    assert score(spark, hit(), [("BARE_URL", True)], "GROUNDED", "v2").brand_domain_cited
    assert rule(score(spark, hit(), [("NATIVE", True), ("NATIVE", False)], "GROUNDED"), "citation").raw_value == 0.5
    tie = score(spark, [*hit(1, sentiment="POSITIVE"), *hit(1, sentiment="NEGATIVE")])
    assert rule(tie, "sentiment").contribution == -10
    with pytest.raises(ValueError):
        scored(spark.range(1), "v1")


def test_exports(spark, tmp_path):
    cells = ["=1+1", "+33", "-2+3", "@SUM", "\tx", 'a"b', "1=1", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string").coalesce(1)
    assert [r.value for r in csv_lines(df).collect()] == ['"\'=1+1"', '"\'+33"', '"\'-2+3"', '"\'@SUM"', '"\'\tx"', '"a""b"', '"1=1"', '""']
    write_csv(df, str(tmp_path / "csv"), ["c"])
    body = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert body.startswith(csv_header(["c"]).encode() + b"\r\n") and body.endswith(b'""\r\n')
    assert safe_filename("Été à l'école !") == "Ete-a-l-ecole" and safe_filename("!!") == "projet"
    assert passport_markdown(spark.createDataFrame([("a|b", None)], "a string, b double")).first().value == "| a\\|b | indisponible |"


def test_passports_of_runs_have_their_intervals(spark):
    from lumenspan.functions.stats import bootstrap, seed_for
    from lumenspan.operators.rollup import query_means
    from lumenspan.sources.tables import completed

    sf = "/root/testdata/sf0.001"
    done = completed(spark, sf).withColumn("engine", F.col("provider"))
    values = {}
    for r in query_means(done, ["run_id", "engine", "mode"]).collect():
        values.setdefault((r.run_id, r.engine, r.mode), []).append((str(r.query_id).encode("utf-16-be"), r.value))
    made, checked = run_passports(spark, sf).collect(), 0
    for r in made:
        for a in r.payload.measurement.axes:
            found = [v for _, v in sorted(values[r.run_id, r.provider, a["mode"]])]
            want = bootstrap(found, seed_for([r.run_id, r.provider, a["mode"], "v3"]))
            assert (a.n, a.nUnit, a.method) == (len(found), "queries", "query-cluster-v1")
            assert (a.interval.low, a.interval.high) == (want or (None, None))
            checked += want is not None
    assert checked > 100


def test_passport(spark):
    cells = [(7, "click", "PARAMETRIC", 12, 60.0, 1.0, False, 1.0, None, None, "pooled"), (7, "click", "GROUNDED", 3, 47.126, 0.666, True, 0.5, 41.0, 52.125, "query-cluster-v1"), (7, "click", "OTHER", 0, None, None, True, None, None, None, None)]
    cells = spark.createDataFrame(cells, "query_id long, provider string, mode string, n long, median double, presence double, low_n boolean, stability double, ci_low double, ci_high double, ci_method string")
    progress = F.struct(F.lit(4).alias("doneSamples"), F.lit(5000).alias("totalSamples"), F.lit(1).alias("failedSamples"), *[F.lit(None).cast("int").alias(c) for c in ("nPlanned", "nSuccessful", "nScored", "missingAnalysis")])
    run = F.struct(F.lit("PARTIAL").alias("status"), F.lit(None).cast("string").alias("completedAt"), progress.alias("progress"))
    found = spark.createDataFrame([(7, "click", "q7", "grounded-erosion", -1234.5)], "query_id long, provider string, title string, kind string, gap double").withColumn("context", run)
    made = passports(found, cells.withColumns({"raw_n": F.col("n"), "cell_n": F.lit(1)}), ["query_id", "provider"], "A|b_c", ["Zed", "Amé*"], "2026-01-02T03:04:05.000Z")
    text = made.select(passport_document(made.payload)).first()[0].split("\n")
    assert text[0] == "# Passeport de mesure — q7" and "- Projet : A\\|b\\_c" in text and "- Marques : Amé\\*, Zed" in text
    assert "- Écart observé groundé − paramétrique : -1\u202f234,5 points" in text and "- Fournisseur : Click (`click`)" in text
    assert "| GROUNDÉ | 47,13 | 41–52,13 | 50\u00a0% | 3 queries | 3 | 1 | oui | query-cluster-v1 | 67\u00a0% |" in text
    assert "| PARAMÉTRIQUE | 60 | indisponible | 100\u00a0% | 12 samples | 12 | 1 | non | pooled | 100\u00a0% |" in text
    assert len([x for x in text if x.startswith("| ")]) == 3  # nothing of a mode without a query
    assert "Run : PARTIAL · terminé indisponible · 4/5\u202f000 appels traités · 1 en échec." in text
    assert "Couverture d’analyse : planifié indisponible, réussi indisponible, scoré indisponible, analyse manquante indisponible." in text
    assert passport_filename("Été: quel CRM ?", "Click", "2026-01-02T03") == "measurement-ete-quel-crm-click-2026-01-02.json"
    assert passport_filename("???", "", "2026-01-02") == "measurement-mesure-mesure-2026-01-02.json"


def test_keyed_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, upsert(old, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c")]
    path = str(tmp_path / "t")
    old.write.partitionBy("k").parquet(path)
    replace_partitions(spark.createDataFrame([("z", 2)], "v string, k int"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "z")]

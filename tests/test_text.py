from pyspark.sql import functions as F

from lorebase.functions import documents as dc, settings, text as tx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


def test_name_key(spark):
    for raw, key in [("GPT-4", "gpt 4"), ("GPT 4", "gpt 4"), ("GPT4", "gpt 4"), ("GPT_4", "gpt 4"), ("v1.0", "v 1 0"), ("A/B", "a b"), ("LLaMA (2023)", "llama 2023"), ("2024", "2024"), ("", ""), ("Café, née", "café née")]:
        assert one(spark, raw, tx.name_key) == key


def test_slug_variants(spark):
    assert one(spark, " A  b_c -- d! ", tx.slugify) == "a-b-c-d"
    assert one(spark, "a -- b", lambda c: tx.slugify(c, collapse_dashes=False)) == "a----b"
    assert len(one(spark, "x" * 200, tx.slugify)) == 80
    assert len(one(spark, "x" * 200, lambda c: tx.slugify(c, size=None))) == 200


def test_domain_keeps_port(spark):
    assert one(spark, "https://www.Example.com:80/a?b", tx.url_domain) == "example.com:80"
    assert one(spark, "no url", tx.url_domain) == ""


def test_trust_is_a_suffix_or_a_folder(spark):
    f = lambda c: tx.trusted(c, F.lit("Work / Papers"), ["arxiv.org"], ["nothing"])
    assert one(spark, "notarxiv.org", f) and not one(spark, "example.org", f)
    assert one(spark, "x.y", lambda c: tx.trusted(c, F.lit("Work / Papers"), [], ["papers"]))


def test_times(spark):
    assert one(spark, "0", tx.unix_seconds) is None and one(spark, "x", tx.unix_seconds) is None
    assert one(spark, "86400", tx.unix_seconds).isoformat().startswith("1970-01-02")
    assert one(spark, "11644473600000001", tx.chrome_micros).year == 1970


def test_placeholder_titles(spark):
    for raw in (None, "", "src_1", "a.pdf", "1706.03762v5", "'1706.03762_2'"):
        assert one(spark, raw, tx.placeholder_title)
    assert not one(spark, "Attention", tx.placeholder_title)


def test_claims(spark):
    text = "Short one. " + "This sentence is long enough to be a claim. " * 6
    assert one(spark, text, tx.key_claims) == ["This sentence is long enough to be a claim."] * 4
    assert one(spark, "Tiny.", tx.key_claims) == ["Tiny."] and one(spark, "  ", tx.key_claims) == [] and one(spark, None, tx.key_claims) == []


def test_terms_and_tokens(spark):
    assert one(spark, "The state-of-art model and RLHF 2024 rlhf", tx.topical_terms) == ["the", "state-of-art", "state", "art", "and", "rlhf"]
    assert one(spark, "rlhf", tx.display_token) == "RLHF" and one(spark, "state-space", tx.display_token) == "State Space" and one(spark, "abc", tx.display_token) == "ABC"


def test_variants_and_mentions(spark):
    assert set(one(spark, "Multi-Models", tx.name_variants)) == {"multi-models", "multi models", "multimodels", "multi-model", "multi model", "multimodel"}
    said = lambda name: spark.createDataFrame([("We trained multi model systems", name)], "t string, n string").select(tx.mentions(F.col("t"), tx.name_variants(F.col("n")))).first()[0]
    assert said("Multi-Models") and said("nedmu") and not said("ned") and not said("other")


def test_links_summary_dates(spark):
    assert one(spark, "[[A#b|c]] [[ d ]] [[A]]", tx.wikilinks) == ["a", "d"]
    assert one(spark, "---\na: b\n---\n# T\n- x\n\nSee [[A]] and `b`.\n", tx.markdown_summary) == "See A and b."
    assert one(spark, "y" * 300, tx.markdown_summary) == "y" * 179 + "…"
    assert one(spark, None, tx.log_date) == "unknown" and one(spark, "2024-01-02T03:04:05Z", tx.log_date) == "2024-01-02 03:04" and one(spark, "around noon, not a date", tx.log_date) == "around noon, not"
    assert one(spark, "D:20240102030405", tx.pdf_date) == "2024-01-02" and one(spark, "x", tx.pdf_date) is None
    assert one(spark, "so: {\"a\": 1} ok", tx.json_object) == '{"a": 1}'
    assert one(spark, "<a><TITLE x> T </title>", tx.html_title) == "T" and one(spark, "<p>a<b>b</p>  c", tx.html_text) == "a b c"


PAPER = "---\nsource_id: x\n---\n## Page 1\nBERT: Pre-training of Deep Bidirectional\nTransformers for Language Understanding\nJacob Devlin Ming-Wei Chang Kenton Lee\nGoogle AI Language\n{a,b}@google.com\nAbstract\nWe introduce a new language representation model called BERT, which stands for encoders.\n1 Introduction\nMore."


def said(spark, rows):
    d = dc.described(spark.createDataFrame(rows, "n int, title string, text string"))
    return {r["n"]: r for r in dc.with_concepts(d).collect()}


def test_paper_heuristics(spark):
    opening = "Title line\n\nshort\n" + "An opening paragraph that is long enough to count as body text. " * 2
    got = said(spark, [(1, "src_ABC_1810.04805.pdf", PAPER), (2, "  Real  title ", PAPER), (3, None, ""), (4, "src_AB_x.pdf", None), (5, None, opening)])
    assert got[1]["title"] == "BERT: Pre-training of Deep Bidirectional Transformers for Language Understanding"
    assert (got[2]["title"], got[3]["title"], got[4]["title"]) == ("Real title", "Untitled Source", "x")
    assert got[1]["abstract"].startswith("We introduce a new language") and got[5]["abstract"].startswith("An opening")
    c = got[1]["concepts"]
    assert c[0] == "BERT" and len({x.lower() for x in c}) == len(c) <= 6
    lines = spark.createDataFrame([("Jacob Devlin Ming-Wei Chang",), ("A Study of the Many Things",)], "x string").select(dc.author_like(F.col("x"))).collect()
    assert [r[0] for r in lines] == [True, False]


def test_key_concepts_of_a_whole_table(spark):
    import re

    def plain(title, summary):
        out = []
        head, colon, tail = title.partition(":")
        for x in [*([head] if colon else []), *re.split(r"\b(?:for|with|using|via|from|in|on)\b", tail if colon else title, maxsplit=1, flags=re.I), *re.findall(r"\b[A-Z][A-Z0-9-]+\b", summary)]:
            x = " ".join(x.strip(" -:;,.").split())
            if x and len(x) <= 80 and x.lower() not in [y.lower() for y in out]:
                out.append(x)
        return out[:6]

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("title", F.lit(None).cast("string"))
    rows = dc.with_concepts(dc.described(d), to="c").collect()
    assert len(rows) >= 200 and all(r["c"] == plain(r["title"], r["abstract"]) for r in rows)


def test_settings(spark):
    assert settings.updated({}, {"llm_provider": "x", "privacy_mode": "local_only", "odd": 1})["privacy_mode"] == "local_only"
    assert settings.updated({}, {"llm_provider": "x"})["llm_provider"] == "anthropic"
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(settings.upsert(a, spark.createDataFrame([("b", 3)], "k string, v int"), ["k"]).collect()) == [("a", 1), ("b", 3)]


def test_stems():
    from lorebase.functions.stemming import stem

    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop falling fall filing file happy happi sky sky relational relat conditional condit vietnamization vietnam triplicate triplic hopefulness hope adjustment adjust adoption adopt controlling control rate rate".split()
    assert [(w, stem(w)) for w in pairs[::2]] == list(zip(pairs[::2], pairs[1::2], strict=True))


def test_cascade(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b")], "n int, ref string")
    gone = spark.createDataFrame([("a",)], "id string")
    assert [tuple(r) for r in settings.cascade(child, "ref", gone).collect()] == [(2, "b")]
    assert sorted(tuple(r) for r in settings.cascade(child, "ref", gone, True).collect()) == [(1, None), (2, "b")]

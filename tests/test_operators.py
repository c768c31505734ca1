import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import extract as X
from lexweave.operators import generate as G
from lexweave.operators import learn as L
from lexweave.operators import pack as P
from lexweave.operators import post as C
from lexweave.operators import sampling as S
from lexweave.operators import stats as M
from lexweave.plans import pipeline, queries
from lexweave.sources.io import Config, ConfigError, load_configs
from lexweave.streaming.clean import clean_stream

TEXTS = [(1, "One two. Three four! Five?"), (2, ""), (3, None), (4, "word"), (5, "A b c. " * 40), (5, "A b c. " * 40)]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA)


def test_words_and_sentences_are_lossless(docs):
    rows = docs.where("text is not null").select("text", F.array_join(T.words(F.col("text")), "").alias("w"), F.array_join(T.sentences(F.col("text")), "").alias("s")).collect()
    assert all(r["text"] == r["w"] == r["s"] for r in rows)


def test_text_functions(spark):
    row = spark.range(1).select(
        T.strip(F.lit("  a\x1f")).alias("a"),
        T.remove_special_tokens(F.lit("[PAD] PADDLE")).alias("b"),
        T.remove_disclosures(F.lit("As an AI language model, Éa HELLO")).alias("c"),
        T.clean_input(F.lit("a->b:\n c")).alias("d"),
        T.remove_disclosures(F.lit("Plain HELLO")).alias("e"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == ("a", " DLE", "Éa hello", "a b c", "Plain HELLO")


def test_template():
    assert X.placeholders("x {a} {{b}} {c}") == ["a", "c"]


def test_template_fill(spark):
    assert spark.range(1).select(X.fill("x {a} {{b}}", a=F.lit("1"))).first()[0] == "x 1 {b}"


def test_sampling_is_seeded_and_complete(docs):
    assert [r["doc_id"] for r in S.sample(docs, "doc_id", 3).collect()] == [r["doc_id"] for r in S.sample(docs.repartition(3), "doc_id", 3).collect()]
    assert S.sample(docs, "doc_id", 100).count() == 6 and S.sample(docs.limit(0), "doc_id", 3).count() == 0


@pytest.mark.parametrize("make", [X.sentence_gaps, X.word_gaps, X.mask_sentences, X.mask_words, X.sentence_rewrites])
def test_extractors_take_nulls_and_empty_tables(docs, make):
    assert make(docs.limit(0), "doc_id", "text").count() == 0
    assert make(docs, "doc_id", "text").where("doc_id = 3").count() == 0


def test_gap_spans(docs):
    docs = docs.where("doc_id <> 5").unionByName(docs.where("doc_id = 5").limit(1))
    gaps = X.sentence_gaps(docs, "doc_id", "text", share=0.9).withColumn("generation", F.lit("made up"))
    pieces = P.gap_pieces(docs, "doc_id", "text", gaps)
    texts = {r["doc_id"]: r["text"] for r in P.join_pieces(pieces, "doc_id").collect()}
    spans = {}
    for r in P.piece_spans(pieces, "doc_id").orderBy("doc_id", "span_no").collect():
        spans.setdefault(r["doc_id"], []).append(r)
    for k, own in spans.items():
        assert own[0]["span_start"] == 0 and own[-1]["span_end"] == len(texts[k])
        for a, b in zip(own, own[1:]):
            assert a["span_end"] == b["span_start"] and a["span_label"] != b["span_label"]


def test_masks(spark):
    masked = spark.createDataFrame([(1, ["A. ", "B. "], [2])], "doc_id bigint, spans array<string>, positions array<int>")
    good = P.mask_pieces(masked, "doc_id", F.lit('ok {"MASK-0": "new"}'))
    assert P.join_pieces(good, "doc_id").first()["text"] == "A. new "
    for bad in ("no object", '{"MASK-0": "te', '{"MASK-1": "x"}'):
        spans = P.piece_spans(P.mask_pieces(masked, "doc_id", F.lit(bad)), "doc_id").collect()
        assert [(s["span_start"], s["span_end"], s["span_label"]) for s in spans] == [(0, 7, "generated")]


def test_complement(spark):
    spans = F.expr("array(named_struct('start', 3, 'end', 5, 'label', 'g'))")
    assert [tuple(s) for s in spark.range(1).select(P.complement(spans, F.lit(8)).alias("x")).first()["x"]] == [(0, 3, "human"), (3, 5, "g"), (5, 8, "human")]


def packed(spark):
    rows = [(1, "a b c d e f g h", "human", "news"), (2, "a b c d e f g h i j", "generated", "news"), (3, "<error>", "generated", "news"), (4, None, None, "news"), (5, "", "human", None), (6, "same", "human", "x"), (7, "same", "generated", "x"), (8, "twice", "human", "x"), (9, "twice", "human", "x")]
    return spark.createDataFrame(rows, "row_id bigint, text string, label string, domain string")


def test_post(spark):
    df = packed(spark)
    ids = lambda x: sorted(r["row_id"] for r in x.collect())
    assert ids(C.drop_errors(df)) == [1, 2, 5, 6, 7, 8, 9]
    assert ids(C.drop_empty(df)) == [1, 2, 3, 6, 7, 8, 9]
    assert ids(C.dedup_texts(df, "row_id")) == [1, 2, 3, 4, 5, 6, 8]
    assert ids(C.drop_label_conflicts(df)) == [1, 2, 3, 5, 8, 9]
    assert ids(C.postprocess(df, "row_id")) == [1, 2, 8]
    assert C.postprocess(df.limit(0), "row_id").count() == 0
    cut = C.truncate(df.where("domain = 'news'"), "row_id").collect()
    assert {r["new_len"] for r in cut} <= {6} and C.truncate(df.limit(0), "row_id").count() == 0


def test_encoding(spark):
    df = spark.createDataFrame([("Ã©tÃ©",), (None,), ("a &amp; b",)], "text string")
    assert [r[0] for r in df.select(C.fix_encoding("text")).collect()] == ["été", None, "a & b"]


def test_stats(spark):
    df = packed(spark).withColumn("model", F.lit("m"))
    assert M.count_errors(df).first()["errors"] == 1
    total = M.errors_per_model(df).where("all_models = 1").first()
    assert (total["texts"], total["errors"]) == (8, 1)
    rep = M.repetition(df.where("row_id = 6"), F.col("text")).first()
    assert (rep["rep_2"], rep["diversity"]) == (100.0, 0.0)
    tags = M.boundary_tags(spark.createDataFrame([(1, "ab cd ef", 5)], "row_id bigint, text string, label bigint"), "row_id", "text", "label")
    assert [r["tag"] for r in tags.orderBy("token_no").collect()] == [0, 0, 1]


def test_learned(spark, docs):
    assert L.language(F.lit("x")) is not None
    got = spark.createDataFrame([(1, "the dog and the cat had a nap"), (2, "il gatto non ha una casa"), (3, "现在"), (4, None), (5, "xyz")], SCHEMA).select("doc_id", L.language(F.col("text")).alias("l")).orderBy("doc_id").collect()
    assert [r["l"] for r in got] == ["en", "it", "zh", None, None]
    assert L.perplexity(docs, "doc_id", "text").where("perplexity <= 0").count() == 0
    assert L._best_cut("x" * 40) is None and L._best_cut("Cat sat. " * 10 + "Incomprehensible heterogeneity notwithstanding considerations." * 3) is not None


def test_generate(spark, docs):
    out = G.generate(docs.where("doc_id = 1"), "text", "mock").first()
    assert out["generation"].startswith("Five?")

    class Fails:
        def __init__(self, **_):
            pass

        def complete(self, prompt, **_):
            raise OSError

    G.PROVIDERS["fails"] = Fails
    assert G.generate(docs, "text", "fails").select("generation").distinct().collect()[0][0] == "<error>"
    assert G.length_parameters("vertex", 1, 9) == {"max_output_tokens": 9} and G.length_parameters("hf_local", 1, 9, {"max_new_tokens": 3}) == {"max_new_tokens": 3, "min_new_tokens": 1}


def config(**more):
    return Config(**({"task": "detection", "domain": "news", "dataset": "d", "text_column": "text", "template": "Go on: {words}", "extractor": "word_prefix", "provider": "mock", "model_name": "m", "language": "multilingual"} | more))


def test_configs(tmp_path):
    assert config().key() == config().key() != config(quantity=3).key()
    for bad in ({"task": "x"}, {"extractor": "x"}, {"extractor": "combined"}, {"extractor": "sentence_gap"}, {"quantity": 0}, {"language": "english"}, {"task": "boundary", "random_sample_human": True}):
        with pytest.raises(ConfigError):
            config(**bad)
    with pytest.raises(ConfigError):
        load_configs(str(tmp_path), "detection")
    (tmp_path / "a.yaml").write_text(json.dumps({"input": {"domain": "n", "dataset": "d", "dataset_text_column": "text", "template": "{text}", "extractor": "auxiliary", "quantity": 50}, "model": {"provider": "mock", "model_name": "m"}, "generation": {"temperature": 1}}))
    assert load_configs(str(tmp_path), "detection", most=7)[0].quantity == 7


def test_pipeline(spark, docs, tmp_path):
    made, counts = pipeline.run(spark, {"d": docs}, [config(), config(task="boundary"), config(extractor="dummy", template="Say {dummy}.")][:1], "run", "doc_id", str(tmp_path))
    assert made.count() > 0 and counts["domain_model"].count() > 0
    again, _ = pipeline.run(spark, {"d": docs.limit(0)}, [config()], "run", "doc_id", str(tmp_path))
    assert again.count() == made.count()
    assert "=>" in pipeline.show(made)


def test_stream(spark, tmp_path):
    packed(spark).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("row_id bigint, text string, label string, domain string").parquet(str(tmp_path / "in"))
    clean_stream(rows).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("cleaned").count() == 6


def test_tokenizers(spark, docs):
    from lexweave.functions.tokenizers import KINDS, OF_PROVIDER, token_length, tokenizer, truncate_tokens

    assert set(OF_PROVIDER.values()) <= set(KINDS)
    for kind in KINDS:
        t = tokenizer(kind)
        assert t.decode(t.encode("a small house")).strip() == "a small house"
    row = docs.where("doc_id = 1").select(token_length(F.col("text"), "words").alias("n"), truncate_tokens(F.col("text"), 2, "words").alias("t")).first()
    assert (row["n"], row["t"]) == (5, "One two.")
    assert docs.where("doc_id = 3").select(token_length(F.col("text"), "words")).first()[0] is None


def test_vendors():
    from lexweave.operators import vendors as V

    assert V.request("amazon.x", "p", {"a": 1}) == {"inputText": "p", "textGenerationConfig": {"a": 1}}
    assert V.answer("cohere.x", {"generations": [{"text": "t"}]}) == "t"
    with pytest.raises(ValueError):
        V.vendor("other.x")


def test_cli(spark, docs, tmp_path, monkeypatch):
    from lexweave import cli

    monkeypatch.setenv("LEXWEAVE_CACHE_DIR", str(tmp_path / "cache"))
    docs.write.parquet(str(tmp_path / "docs"))
    (tmp_path / "c.yaml").write_text(json.dumps({"input": {"domain": "n", "dataset": "d", "dataset_text_column": "text", "template": "Go on: {words}", "extractor": "word_prefix", "language": "multilingual"}, "model": {"provider": "mock", "model_name": "m"}}))
    cli.main(["generate", "--config", str(tmp_path / "c.yaml"), "--task", "detection", "--corpus", f"d={tmp_path / 'docs'}", "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0 and (tmp_path / "out-statistics" / "errors.md").exists()


def test_simple_model_takes_all_lengths_and_converges(spark, monkeypatch):
    # the two texts share all word 1-2-grams and character 3-grams; only longer ones tell them apart
    rows = [(i, "m p m q m" if i % 2 else "m q m p m", "human" if i % 2 else "generated") for i in range(20)]
    fits, fit = [], L.LogisticRegression.fit
    monkeypatch.setattr(L.LogisticRegression, "fit", lambda self, df: fits.append((fit(self, df), self.getMaxIter())) or fits[-1][0])
    got = L.simple_model(spark.createDataFrame(rows, "row_id bigint, text string, label string"), "row_id", "text", F.col("label"), k=2).collect()
    assert len(got) == 4 and all(r["f1"] == 1.0 for r in got)
    assert all(m.numFeatures == 6 << 14 and m.summary.totalIterations < most for m, most in fits)


def test_simple_model_trains_on_a_bare_column(spark, monkeypatch):
    class Seen(Exception):
        pass

    def fit(self, df):
        raise Seen(len(df.schema["features"].json()))

    monkeypatch.setattr(L.LogisticRegression, "fit", fit)
    with pytest.raises(Seen) as seen:
        L.simple_model(spark.createDataFrame([(i, f"a b c {i}", "xy"[i % 2]) for i in range(20)], "row_id bigint, text string, label string"), "row_id", "text", F.col("label"), k=2)
    # not a name for each of 98,304 buckets
    assert seen.value.args[0] < 1000


def test_random_examples_come_from_all_texts(spark):
    n = 6000
    got = X.examples_random(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), "doc_id", "text", 3).collect()
    rows = {}
    for r in got:
        rows.setdefault(r["doc_id"], []).append(r["example_id"])
    assert len(rows) == n and all(len(x) == len(set(x)) == 3 for x in rows.values())
    # each text is drawn with a chance of 1 - 1 / e^3, and the larger half as often as the smaller
    drawn = [r["example_id"] for r in got]
    assert len(set(drawn)) > 0.93 * n and abs(sum(x >= n // 2 for x in drawn) / len(drawn) - 0.5) < 0.02
    two = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None)], SCHEMA)
    assert sorted((r["doc_id"], r["example_id"]) for r in X.examples_random(two, "doc_id", "text", 3).collect()) == [(i, x) for i in (1, 2, 3, 4) for x in (1, 3)]
    assert X.examples_random(two.where("text is null"), "doc_id", "text").count() == 0


def test_slotted_examples_follow_the_ring(spark):
    n, texts = 3000, 300
    got = X.examples_slotted(spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < texts, "t").alias("text")), "doc_id", "text").collect()
    h = lambda *k: int(hashlib.md5(":".join(map(str, k)).encode()).hexdigest()[:8], 16)
    ring = {}
    for i in range(texts):
        ring[h(13, i) >> 20] = min(i, ring.get(h(13, i) >> 20, i))
    at = sorted(ring)
    held = lambda slot: ring[next((s for s in at if s >= slot), at[0])]
    want = {(i, no, held(h(14, i, no) * X.RING >> 32)) for i in range(n) for no in (1, 2)}
    assert {tuple(r) for r in got} == want and len(got) == 2 * n
    none = spark.createDataFrame([(1, None)], SCHEMA)
    assert X.examples_slotted(none, "doc_id", "text").count() == 0


@pytest.mark.parametrize("task", ["detection", "attribution"])
def test_post_repairs_encoding_and_balances(spark, task):
    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    rows = [(1, words(10, "a"), "x", "n"), (2, words(30, "b"), "y", "n"), (3, words(8, "Ã©tÃ©"), "x", None), (4, words(20, "c"), "y", None), (5, words(40, "é"), "x", "m"), (6, words(40, "Ã©"), "y", "m")]
    df = spark.createDataFrame(rows, "row_id bigint, text string, label string, domain string")
    got = {r["row_id"]: r["text"] for r in C.postprocess(df, "row_id", task).collect()}
    assert {k: len(v.split()) for k, v in got.items()} == {1: 8, 2: 8, 3: 6, 4: 6}
    assert got[3].startswith("été0 été1")
    assert C.postprocess(df.where("label = 'x'"), "row_id", task).where("row_id = 1").first()["text"] == words(10, "a")


def test_postprocess_full_leaves_encoding_and_lengths(spark, tmp_path):
    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    rows = [(1, words(10, "a"), "x", "n"), (2, words(30, "b"), "y", "n"), (3, " Ã©tÃ© ", "x", None), (4, "<error>", "y", "n"), (5, words(30, "b"), "y", "m"), (6, "same", "x", "n"), (7, "same", "y", "n"), (8, None, "x", "n")]
    spark.createDataFrame(rows, "row_id bigint, text string, label string, domain string").write.parquet(str(tmp_path / "generated_dataset.parquet"))
    got = {r["row_id"]: r["text"] for r in queries.QUERIES["postprocess_full"](spark, str(tmp_path)).collect()}
    assert got == {1: words(10, "a"), 2: words(30, "b"), 3: "Ã©tÃ©"}
    # the query with all steps still has them
    assert {r["row_id"]: len(r["text"].split()) for r in queries.QUERIES["postprocess_all"](spark, str(tmp_path)).collect()}[2] < 30


def test_pipeline_keys_are_unique_per_row(spark, tmp_path):
    # a text of row 1 that row 2 repeats has the smallest key of another text
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40))) for i in (1, 2)], SCHEMA)
    made, _ = pipeline.run(spark, {"d": docs}, [config(extractor="dummy", template="Say {dummy}.", task="boundary")], "r", "doc_id", str(tmp_path))
    assert made.count() == made.select("text").distinct().count() == 1
    human, _ = pipeline.run(spark, {"d": docs}, [config(extractor="auxiliary", template="{text}"), config(extractor="auxiliary", template="On: {text}")], "r", "doc_id", str(tmp_path))
    assert human.count() == human.select("text").distinct().count()


MIXED = {
    "sentence_gap": ({"gap_token": "__", "max_percentage_boundaries": 0.9, "max_sentence_span": 2}, "Fill {n}: {boundaries}"),
    "word_gap": ({"gap_token": "__", "max_percentage_boundaries": 0.1, "max_word_span": 3, "range_boundary_size": [2, 3]}, "Fill {n}: {boundaries}"),
    "sentence_masking": ({"mask_token": "HOLE", "percentage_range": [0.3, 0.4]}, "{masked_text}"),
    "word_masking": ({"mask_token": "MASK", "percentage_range": [0.2, 0.3], "span_length_range": [2, 3]}, "{masked_text}"),
    "sentence_rewriting": ({"percentage_range": [0.3, 0.4]}, "Rewrite: {sentence}"),
}


@pytest.mark.parametrize("extractor", sorted(MIXED))
def test_pipeline_mixcase(spark, tmp_path, extractor, monkeypatch):
    class Fills:
        def __init__(self, **_):
            pass

        def complete(self, prompt, **_):
            return json.dumps({m: "new" for m in __import__("re").findall(r"(?:MASK|HOLE)-[0-9]+", prompt)}) if "masking" in extractor else "new"

    monkeypatch.setitem(G.PROVIDERS, "fills", Fills)
    args, template = MIXED[extractor]
    docs = spark.createDataFrame([(i, f"  Text {i} begins here. " + "A b c d. E f g h! " * 6) for i in (1, 1, 2)], SCHEMA)
    made, _ = pipeline.run(spark, {"d": docs}, [config(task="mixcase", extractor=extractor, extractor_args={extractor: args}, template=template, provider="fills")], "r", "doc_id", str(tmp_path))
    rows = made.collect()
    assert {r["model"] for r in rows} == {"human", "m"}
    for r in rows:
        at = [(s["start"], s["end"]) for s in r["label"]]
        assert at[0][0] == 0 and at[-1][1] == len(r["text"]) and all(a[1] == b[0] for a, b in zip(at, at[1:]))
        said = [r["text"][s["start"]:s["end"]].strip() for s in r["label"] if s["label"] == "generated"]
        assert bool(said) == (r["model"] == "m") and all(set(x.split()) == {"new"} for x in said)


def test_pipeline_mixcase_needs_rows(spark, docs):
    with pytest.raises(ValueError):
        pipeline.build(docs, config(task="mixcase"), "doc_id")

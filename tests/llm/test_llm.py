import random
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from lexweave.llm import copies as C
from lexweave.llm import crf, mixing, packing, pairs, reading
from lexweave.llm.common import is_empty
from lexweave.llm.cutoff import share_cut, truncated
from lexweave.llm.language import Judge, label_names, named, segments
from lexweave.llm.units import sentence_units, units
from tests.llm.heldout import ANSWERED, REFUSED


def split(text):
    return [text[a:b] for a, b in units(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. Ames paid 3.5 euros, i.e. little. We left at 7 a.m. Then it rained.", ["Dr. Ames paid 3.5 euros, i.e. little.", "We left at 7 a.m.", "Then it rained."]),
        ('"Where is it?" asked Tom. She wrote, "Go. Now." He left.', ['"Where is it?" asked Tom.', 'She wrote, "Go. Now."', "He left."]),
        ("Am 3. Mai kam er. Siehe S. 12 (ja!) und mehr.", ["Am 3. Mai kam er.", "Siehe S. 12 (ja!) und mehr."]),
        ("他写道：“走吧。没有人。”孩子们画画。“在哪里？”老人问。", ["他写道：“走吧。没有人。”", "孩子们画画。", "“在哪里？”老人问。"]),
        ("彼は「帰りなさい。」と書きました。次です。", ["彼は「帰りなさい。」と書きました。", "次です。"]),
        ("ราคาสูงขึ้นร้อยละ 12.8 แต่ไม่มีใครบ่น เด็กๆวาดรูป", ["ราคาสูงขึ้นร้อยละ 12.8 แต่ไม่มีใครบ่น", "เด็กๆวาดรูป"]),
        ("यह घर है। प्रो. अ. ब. कोरवाल आए। क्या?", ["यह घर है।", "प्रो. अ. ब. कोरवाल आए।", "क्या?"]),
        ("ارتفع السعر 5.8... لكن أحدا لم يشتك. من هنا؟", ["ارتفع السعر 5.8... لكن أحدا لم يشتك.", "من هنا؟"]),
        ("A heading\n\nA wrapped\nline here. Next.\n- one\n- two words\n", ["A heading", "A wrapped\nline here.", "Next.", "- one", "- two words"]),
        ("we ate cake. can you come? see no. 12.", ["we ate cake.", "can you come?", "see no. 12."]),
        ("It ended.So they left.", ["It ended.", "So they left."]),
    ],
)
def test_units(text, want):
    assert split(text) == want


def test_units_cover_every_text():
    rng = random.Random(1)
    signs = list("ab. A!?\n\"«»“”()…。」「ก ५-1:")
    for _ in range(800):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
        got = units(text)
        assert all(a < b and text[a:b] == text[a:b].strip() for a, b in got)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        inside = {i for a, b in got for i in range(a, b)}
        assert all(ch.isspace() or i in inside for i, ch in enumerate(text))
    assert units(None) == units("  \n") == [] and len(units("Long text. " * 20000)) == 20000


def test_units_operator(spark):
    df = spark.createDataFrame([(1, "A bb. C d.", "x"), (2, None, "x"), (3, " ", None), (1, "A bb. C d.", "x"), (None, "A.", "x")], "doc_id bigint, text string, key string")
    assert sorted(tuple(r) for r in sentence_units(df).collect()) == [(1, 0, 5), (1, 0, 5), (1, 6, 10), (1, 6, 10)]
    assert sentence_units(df.limit(0)).count() == 0


def test_empty(spark):
    texts = [None, "", " \u200b", "N/A", "[PAD][PAD]", "<error>", "...", "Sure! Here is the text:", "No.", "Read this: it ends.", "x" * 300]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", is_empty(F.col("t")).alias("e")).orderBy("i").select("e").collect()]
    assert got == [True] * 8 + [False] * 3


CODES = [("en", "eng", "English"), ("es", "spa", "Spanish"), ("de", "deu", "German"), ("ja", "jpn", "Japanese"), ("und", "und", "no natural language")]


def corpus(spark):
    base = {"en": "The old man went to the house and it was closed.", "es": "El viejo fue a la casa y estaba cerrada por la noche.", "de": "Der alte Mann ging in das Haus und es war nicht offen.", "ja": "古い家に行きましたが、もう閉まっていました。"}
    return base, spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(base.items())], "doc_id bigint, text string, lang string")


def test_labels():
    names = label_names([dict(zip(("lang", "iso3", "lang_name"), c)) for c in CODES])
    assert [named(x, names) for x in (" EN-us", "spa", "GERMAN", "de_AT", "xx", None, "", "und")] == ["en", "es", "de", "de", None, None, None, "und"]


def test_segments(spark):
    base, docs = corpus(spark)
    codes = spark.createDataFrame(CODES, "lang string, iso3 string, lang_name string")
    mixed = [(1, base["en"] + " " + base["en"] + " " + base["de"], "en"), (2, "12 | 7", "und"), (3, base["ja"], "ja"), (4, None, "en"), (5, "N/A", None), (6, base["es"], None)]
    df = spark.createDataFrame(mixed, "row_id bigint, text string, lang string")
    rows = sorted((r["row_id"], r["seg_no"], r["lang"], r["named"]) for r in segments(df, docs, codes, ["row_id"], "text", "lang").collect())
    assert rows == [(1, 1, "en", True), (1, 2, "de", False), (2, 1, "und", True), (3, 1, "ja", True), (6, 1, "es", False)]
    assert segments(df.limit(0), docs.limit(0), codes, ["row_id"], "text", "lang").count() == 0


def test_forward_backward_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    e, m = rng.normal(size=(4, 3)).astype("float32"), rng.normal(size=(3, 3)).astype("float32")
    want = np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(sum(e[k, y] for k, y in enumerate(path)) + sum(m[a, b] for a, b in zip(path, path[1:])))
        for k, y in enumerate(path):
            want[k, y] += w
    assert np.allclose(crf.marginals(e, np.array([4]), m)[0], want / want[0].sum(), atol=1e-5)


def test_suffix_automaton_against_search():
    rng = random.Random(2)
    for _ in range(300):
        own = [rng.choice("abc") for _ in range(rng.randint(1, 8))]
        said = [rng.choice("abcd") for _ in range(rng.randint(0, 8))]
        runs, at = pairs.SuffixAutomaton(own).runs(said), 0
        for n in runs:
            piece = said[at : at + max(n, 1)]
            assert (n > 0) == any(own[k : k + len(piece)] == piece for k in range(len(own)))
            at += max(n, 1)
        assert at == len(said)


def test_pairs(spark):
    base, docs = corpus(spark)
    model = crf.fit([], ["de", "en", "es", "ja"])
    ask = "Write a short text about the old house."
    rows = [(1, ask, None), (2, ask, "I'm sorry, but I can't write about the old house."), (3, ask, ask + "\n" + ask), (4, ask, base["es"]), (5, ask, base["en"]), (6, None, None), (7, "NO-PROMPT", ""), (8, "Answer in Spanish: " + ask, base["en"]), (9, ask, ask + " The house was red and it had a door.")]
    df = spark.createDataFrame(rows, "row_id bigint, prompt string, text string")
    cut = spark.createDataFrame([(5,)], "row_id bigint")
    assert sorted(tuple(r) for r in pairs.defects(df, model, cut).collect()) == [(1, "empty"), (2, "refusal"), (3, "copy"), (4, "language"), (5, "truncated"), (8, "language")]
    assert pairs.defects(df.limit(0), model, cut).count() == 0


def test_levels():
    model = reading.Levels([("the cat sat on the mat", "low"), ("heterogeneity presupposes exogeneity", "high")])
    assert model.band("THE CAT!")[0] == "low" and model.band("Exogeneity, heterogeneity.")[0] == "high"


def cut_texts():
    rng = random.Random(3)
    who, where = ["baker", "farmer", "teacher", "doctor"], ["old harbour", "town hall", "river bank", "main road"]
    make = lambda: f"Nobody near the {rng.choice(where)} expected the {rng.choice(who)} to come home so early. "
    return [(i, (make() * 3 + make()).strip()) for i in range(120)]


def test_truncated(spark):
    whole = cut_texts()
    full = whole[0][1]
    more = [(1000, full[:-30]), (1001, full[:-32] + "…"), (1002, full[:-1]), (1003, None), (1004, "N/A"), (1005, full + " *****"), (1006, "She wrote, \"Leave now."), (1007, "12 | 13 |")]
    df = spark.createDataFrame(whole + more, "row_id bigint, text string").withColumn("model", F.lit("m"))
    assert sorted(r["row_id"] for r in truncated(df).collect()) == [1000, 1001, 1006]
    assert truncated(df.limit(0)).count() == 0
    assert share_cut(df).first()["cut"] == 3


WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+(?:(?<=\p{Nd})[.,:](?=\p{Nd})[\p{L}\p{M}\p{Nd}]+)*")


def test_copies_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["Hello, big world number 3.5!", "hello big  WORLD number 3.5", "Hello big world number 3 5", "Another text of some length.", "short", None]
    rows = [(i, rng.choice(texts), rng.choice(["human", "Human.", "m 7b", "M-7B", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, label string")
    groups = defaultdict(list)
    for i, t, label in rows:
        if t and label and len(regex.findall(r"[\p{L}\p{Nd}]", t)) >= 12:
            groups[tuple(WORD.findall(t.lower())), tuple(WORD.findall(label.lower()))].append(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert {tuple(r) for r in C.copies(df, "row_id", C.text_fields(df)).collect()} == want
    assert {(r["row_id"], r["copies"]) for r in C.collapse(df, "row_id", C.text_fields(df)).collect()} == {(min(g), len(g)) for g in groups.values()}
    assert C.copies(df.limit(0), "row_id", C.text_fields(df)).count() == 0


def test_payload_copies(spark):
    rows = [(1, '{"a": "X y", "B": "1"}'), (2, '{ "b":"1" ,"A":"x  Y!"}'), (3, '{"a": "X y"'), (4, None), (5, "[]"), (6, '{"a": "X y"}'), (7, "null")]
    df = spark.createDataFrame(rows, "record_id bigint, payload string")
    assert [tuple(r) for r in C.copies(df, "record_id", C.payload_fields(df)).collect()] == [(1, 2)]


def test_plan_uses_every_item_once():
    rng = random.Random(5)
    for capacity, separator in ((16, 1), (32, 0), (40, 2)):
        counts = {s: rng.randint(0, 9) for s in range(1, capacity + 1)}
        used = defaultdict(int)
        for sizes, times in packing.plan(counts, capacity, separator):
            assert sum(sizes) + separator * (len(sizes) - 1) <= capacity
            for s in sizes:
                used[s] += times
        assert {k: n for k, n in counts.items() if n} == dict(used)


def test_pack(spark):
    sizes = spark.createDataFrame([(i, (i * 7) % 23) for i in range(60)] + [(60, 100), (61, None)], "doc_id bigint, tokens bigint")
    specs = spark.createDataFrame([("c", 20, 1), ("d", 64, 0)], "container_name string, capacity_tokens int, separator_tokens int")
    rows = packing.pack(sizes, specs).collect()
    for name, capacity, separator in (("c", 20, 1), ("d", 64, 0)):
        own = [r for r in rows if r["container_name"] == name]
        assert sum(r["size"] for r in own) == sum((i * 7) % 23 for i in range(60)) + 100
        assert len({(r["doc_id"], r["part_no"]) for r in own}) == len(own)
        held = defaultdict(list)
        for r in own:
            held[r["container_no"]].append(r["size"])
        assert all(sum(h) + separator * (len(h) - 1) <= capacity for h in held.values())
    assert packing.pack(sizes.limit(0), specs).count() == 0


def test_sainte_lague():
    assert mixing.sainte_lague([0.5, 0.3, 0.2], 10, [99, 99, 99]) == [5, 3, 2]
    assert mixing.sainte_lague([0.5, 0.5], 10, [2, 99]) == [2, 8] and mixing.sainte_lague([1.0], 5, [0]) == [0]


def test_mix(spark):
    rows = [(i, "big" if i % 3 else "small", 10) for i in range(3000)] + [(9000, None, 5), (9001, "small", 0)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("m", "big", 0.6, 1), ("m", "small", 0.4, 2), ("n", "absent", 0.5, 3), ("n", "small", 0.5, 2)], "mix_name string, source string, target_weight double, max_repeats int")
    mixed = mixing.mix(sizes, targets)
    assert mixed.where("source = 'small' and repeats > 2 or source = 'big' and repeats > 1").count() == 0
    got = {(r["mix_name"], r["source"]): r["share"] for r in mixing.shares(mixed, targets).collect()}
    assert abs(got["m", "big"] - 0.6) < 0.03 and got["n", "absent"] == 0 and got["n", "small"] == 1
    assert mixing.mix(sizes.limit(0), targets).count() == 0


def test_judge_forgets():
    judge = Judge(crf.fit([], ["de", "en"]))
    judge.FULL = 1
    judge.learn(["the house and the man"])
    judge.learn(["der mann und das haus", "x"])
    assert judge.labels[int(judge.known["der mann und das haus"].argmax())] == "de"


def test_refusals_of_a_held_out_set():
    p, asked = pairs.Pairs(crf.fit([], ["de", "en"])), "Tell me of 1200 blue kites."
    missed = [t for own in REFUSED.values() for t in own if not p.refuses(asked, t)]
    total = sum(map(len, REFUSED.values()))
    print(f"recall {1 - len(missed) / total:.3f} of {total}", missed)
    assert len(missed) <= 0.1 * total
    assert [t for t in ANSWERED if p.refuses(asked, t)] == []


def test_refusals_and_copies_of_any_length():
    p = pairs.Pairs(crf.fit([], ["de", "en"]))
    long = "I'm sorry, but I can't write about that. I am unable to help with this request. I must decline. I won't discuss it. I cannot provide a text on this topic. Please consult another source. "
    assert p.refuses("Write.", long) and p.refuses("Write.", long * 10) and not p.refuses("Write.", long + "The old mill stood by the river.")
    assert pairs.is_copy("Say a b c d.", "Say a b c d. " * 400) and not pairs.is_copy("Say a b c d.", "Say a b c d. " * 400 + "e")


def test_markers_of_any_length(spark):
    texts = ["[PAD]" * 60, "[PAD]" * 6000 + "x", "null\n" * 500, "*" * 5000]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(is_empty(F.col("t"))).collect()]
    assert got == [True, False, True, True]


OPEN = [
    ("She said it (see the plan (page two) here) and left the room.", False), ("He bought a 5\" pipe for the old well.", False), ("We were late again :( but the party was lovely.", False), ("He wrote, \"Leave now.", True),
    ("He wrote, \"Leave now. " + "The old mill stood by the river. " * 40, True), ("He wrote, \"Leave now.\" " + "The old mill stood by the river. " * 40, False), ("Il dit : « Partez. Il ne reste personne. »", False), ("Il dit : « Partez.", True),
    ("Er rief: „Kommt her!“ und ging.", False), ("他写道：“走吧。没有人。", True), ("他写道：“走吧。没有人。”", False), ("a) one\nb) two.", False), ("»Kommt her!«, rief er laut.", False), ("See [the list.", True), ("\"One.\n\nIt was late.\"", False),
]


def test_delimiters(spark):
    from lexweave.llm.cutoff import tails

    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(OPEN)], "row_id bigint, text string")
    got = {r["id"] for r in tails(df, "row_id", "text").where("sure").collect()}
    assert got == {i for i, (_, cut) in enumerate(OPEN) if cut}


def test_decoration_and_contexts_of_any_size(spark):
    whole = cut_texts()
    full = whole[0][1]
    more = [(1000, full[:-30] + "\n" + "* " * 3000), (1001, full + "\n" + "* " * 3000), (1002, full[:-30] + " https://a.example/" + "x" * 900), (1003, "#" * 100_000), (1004, "a." * 50_000)]
    df = spark.createDataFrame(whole + more, "row_id bigint, text string")
    assert sorted(r["row_id"] for r in truncated(df).collect() if r["row_id"] < 1003) == [1000, 1002]
    # without the table of what is asked for every trigram is counted, with the same result
    assert sorted(r["row_id"] for r in truncated(df, map_limit=0).collect()) == sorted(r["row_id"] for r in truncated(df).collect())


def test_levels_need_english_and_known_words(spark):
    model = crf.fit([], ["de", "en", "es", "zh"])
    samples = spark.createDataFrame([("the cat sat on the mat", "low"), ("heterogeneity presupposes exogeneity", "high")], "text string, band string")
    rows = [(1, "The cat sat on the mat and it was his."), (2, "Die Katze lag auf der Matte und sie war nicht allein."), (3, "这里没有已经现在的猫。"), (4, None), (5, "With his they had been."), (1, "The cat sat on the mat and it was his.")]
    got = sorted((r["row_id"], r["band"]) for r in reading.levels(spark.createDataFrame(rows, "row_id bigint, text string"), samples, model).collect())
    assert got == [(1, "low"), (1, "low"), (2, None), (3, None), (5, None)]


def test_shards_and_shares_grow_with_the_items(spark):
    rows = [(i, "big" if i % 3 else "small", 1 + i % 40) for i in range(3000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.5, 2)], "mix_name string, source string, target_weight double, max_repeats int")
    for texts in (10, 100_000):
        mixed = mixing.mix(sizes, targets, shard_texts=texts)
        got = {r["source"]: r["tokens"] for r in mixing.shares(mixed, targets).collect()}
        assert abs(got["big"] - got["small"]) <= 45 and mixed.groupBy("doc_id").count().where("count > 1").count() == 0
    specs = spark.createDataFrame([("c", 40, 1)], "container_name string, capacity_tokens int, separator_tokens int")
    for share in (7, 100_000):
        packed = packing.pack(sizes, specs, share_items=share)
        assert packed.select("doc_id").distinct().count() == packed.count() == 3000
        assert packed.groupBy("container_no").agg((F.sum("size") + F.count("size") - 1).alias("used")).where("used > 40").count() == 0


def test_cut_texts_do_not_vouch_for_each_other(spark):
    # 40 copies of each cut text, and others cut inside the same word, with marks behind the break
    whole = cut_texts()
    full = whole[0][1]
    cut = [full[:-30], full[:-32] + "…", full[:-4] + " [...]", full[:-8] + "…\n", "It was " + full[:-4] + "…"]
    rows = whole + [(1000 * (k + 1) + i, t) for k, t in enumerate(cut) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id bigint, text string")
    want = sorted(i for i, _ in rows if i >= 1000)
    assert sorted(r["row_id"] for r in truncated(df).collect()) == want
    # the whole table again and again under other keys
    times = [df.withColumn("row_id", F.col("row_id") + F.lit(10**6 * k)) for k in range(3)]
    again = truncated(times[0].unionByName(times[1]).unionByName(times[2]))
    assert sorted(r["row_id"] for r in again.collect()) == [10**6 * k + i for k in range(3) for i in want]


def test_truncated_pairs_in_copies(spark):
    text = cut_texts()[0][1]
    rows = [(i, "NO-PROMPT", t) for i, t in cut_texts()] + [(1000 + i, "Who came home near the town hall?", text[:-32] + "…") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id bigint, prompt string, text string")
    got = pairs.defects(df, crf.fit([], ["de", "en", "es", "fr"]), truncated(df)).collect()
    assert sorted(r["row_id"] for r in got if r["defect"] == "truncated") == [1000 + i for i in range(40)]


def test_misspelt_words_do_not_vouch_for_cut_ones(spark):
    # "earl" for "early" where the sentence ends and inside it: known often enough, and no proof that a text may end there
    whole = cut_texts()
    full = whole[0][1]
    odd = [(500 + i, full[:-2] + ".") for i in range(3)] + [(600 + i, full[:-2] + " and to leave again. " + full) for i in range(3)]
    rows = [(i, "NO-PROMPT", t) for i, t in whole + odd] + [(1000 + i, "Who came home near the town hall?", full[:-2]) for i in range(2)]
    df = spark.createDataFrame(rows, "row_id bigint, prompt string, text string")
    found = truncated(df)
    assert sorted(r["row_id"] for r in found.collect()) == [1000, 1001]
    got = pairs.defects(df, crf.fit([], ["de", "en", "es", "fr"]), found).collect()
    assert sorted(r["row_id"] for r in got if r["defect"] == "truncated") == [1000, 1001]


def test_truncated_asked_of_some_alone(spark):
    # the other rows, and texts without a Latin letter, count for those asked for as they do when all are asked for
    whole = cut_texts()
    full = whole[0][1]
    more = [(1000 + i, full[:-30]) for i in range(3)] + [(1010, full[:-2]), (1011, full + " 4 5 6"), (1012, full + " 7 8 9"), (1013, full[:-32] + "…"), (1014, "Мы видели: \"Иди. Уже")]
    figures = [(2000 + i, f"Мы видели 4 5 6 раз {i}.") for i in range(5)] + [(2010 + i, "12 13 14") for i in range(5)]
    for rows in (whole + more, whole + more + figures):
        df = spark.createDataFrame(rows, "row_id bigint, text string")
        everything = {r["row_id"] for r in truncated(df).collect()}
        for own in ([1000, 1010, 1011, 1012, 1013], [1000, 1001, 1010, 1013, 5], [1011]):
            ids = spark.createDataFrame([(i,) for i in own], "row_id bigint")
            for limit in (0, 27):
                got = {r["row_id"] for r in truncated(df, map_limit=limit, among=ids).collect()}
                assert got & set(own) == everything & set(own)


def test_language_of_a_prompt_does_not_hang_on_its_names():
    p = pairs.Pairs(crf.fit([], ["en", "es", "fr", "it", "pt"]))
    ask = "Escribe una noticia breve a partir de este resumen: la visita de Nilol Perarel a la sierra."
    p.judge.learn([ask])
    # a model that takes the name and words it does not know for French
    p.judge.known[ask] = p.judge.known[ask] * 0 + [1.0, 5.0, 6.0, 3.0, 2.0]
    assert p.own_language(ask) == "es"


def test_copies_are_compared_where_fingerprints_agree(spark, monkeypatch):
    # fingerprints that tell nothing: only the fields can
    rows = [(i, f"A text of some length, number {i % 7}", "Human" if i % 2 else "human!") for i in range(60)] + [(3, "A text of some length, number 3", "x")]
    df = spark.createDataFrame(rows, "row_id bigint, text string, label string")
    want = {(i % 7, i) for i in range(7, 60)}
    own = C._hashed
    for blind in (False, True):
        if blind:
            monkeypatch.setattr(C, "_hashed", lambda *a: own(*a).withColumns({f: F.lit(0).cast("bigint") for f in C.FINGERPRINT}))
        for limit in (0, C.MAP_LIMIT):
            assert {tuple(r) for r in C.copies(df, "row_id", C.text_fields(df), limit).collect()} == want
            got = sorted(tuple(r) for r in C.collapse(df, "row_id", C.text_fields(df), limit).collect())
            assert got == sorted([(k, len(range(k, 60, 7))) for k in range(7)] + [(3, 1)])

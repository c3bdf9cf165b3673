"""Training-data operators on small cases made for what they could miss."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from folioscope.llm import chat_formatting, language_id
from folioscope.llm import ngram_jaccard as jaccard
from folioscope.llm import toxicity


def hidden_link() -> dict[str, list[str]]:
    """Word sets of 16: x and y link, z links with neither but looks nearer to both by bitmap, and has been probed with both
    (short lists of a and of b). All lists that x and y share are long ones, with p as pivot."""
    words = [f"w{i}" for i in range(4000)]
    g = np.array([jaccard.shingle_sets(pa.array([w]), 1)[1][0] for w in words])
    by = [words[i] for i in np.argsort(g)]
    h = dict(zip(words, g.tolist(), strict=True))
    (a, a2, b, b2), lists, rest = by[:4], by[4:7], by[7:]
    for at in range(0, 1000, 30):
        c = rest[at : at + 11]
        free = [w for w in rest if w not in c]
        z = [next(w for w in free if h[w] % 64 == h[v] % 64) for v in c[-2:]]
        sets = {"x": [a, a2, *lists, *c], "y": [b, b2, *lists, *c], "z": [a, b, *lists, *c[:-2], *z], "p": [*lists, *[w for w in free if w not in z][at + 200 : at + 213]]}
        _, found, first = jaccard.shingle_sets(pa.array([" ".join(v) for v in sets.values()]), 1)
        s = dict(zip(sets, jaccard.signatures(found, first)[0].view(np.int64).tolist(), strict=True))
        order = sorted(sets, key=s.get)
        if len(set(z)) == 2 and order[0] == "p" and order[1] != "z":
            return sets
    raise AssertionError("no order of signatures fits")


def test_a_link_behind_a_failed_nearest_pair(spark):
    sets = hidden_link()
    docs = spark.createDataFrame([(i, " ".join(v)) for i, v in enumerate(sets.values())], "doc_id long, text string").repartition(4, "doc_id")
    found = {r.doc_id: r.component_id for r in jaccard.similar_components(docs, k=1, short=2).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3}


def learned(n: int) -> list[int]:
    """Ids of rows that aren't held out."""
    return [i for i in range(3 * n + 20) if zlib.crc32(str(i).encode()) % 3 != 1][:n]


def test_texts_that_begin_alike_are_all_learned_from(spark):
    rows = [("scum", 1), ("vermin", 1), ("filth", 1), ("tea", 0), ("cake", 0), ("bread", 0)]
    texts = [(f"User wrote on Monday {w} again", y) for w, y in rows] + [("USER wrote on  Monday scum again", 1), (None, 0)]
    ids = learned(len(texts))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(ids, texts, strict=True)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, texts, strict=True)], "doc_id long, toxic int")
    found = [(toxicity.folded(r.text or "").split(), r.toxic) for r in toxicity.training_rows(docs, labels).collect()]
    want = [(toxicity.folded(t or "").split(), y == 1) for t, y in texts[:6] + texts[7:]]
    assert sorted(found) == sorted(want)
    assert len(toxicity.training_rows(docs, labels, 2).collect()) == 4


def test_a_rare_toxic_word_is_learned_however_many_labels_there_are(spark):
    common = [(f"you are an idiot number{i}", True) for i in range(2480)] + [(f"good morning number{i}", False) for i in range(2500)]
    rare = [(f"listen gribble number{i}", True) for i in range(2480, 2500)]
    model = toxicity.fit(spark.createDataFrame(common + rare, "text string, toxic boolean"))
    rude, fine = model.scores(["that gribble there", "that kettle there"])
    assert rude > fine


def test_every_toxic_text_with_a_candidate_is_covered():
    texts = [frozenset({" aaa ", " bbb "}), *[frozenset({" aaa ", " ccc "})] * 5, frozenset({" zzz "})]
    chosen = toxicity._cover(texts, dict.fromkeys((" aaa ", " bbb ", " ccc ", " zzz "), 0))
    assert chosen == [" aaa ", " ccc ", " zzz "]


def test_a_text_in_six_languages_keeps_them_all(spark):
    words = {c * 2: " ".join(c * n for n in range(3, 23)) for c in "abcdef"}
    langs, logs = language_id.fit(spark.createDataFrame([(t, c) for c, t in words.items()], "text string, lang string"))
    texts = pa.array([" ".join(words.values()), words["aa"], f"{words['bb']} {words['cc']}"])
    share = language_id.proportions(*language_id.buffers(texts), logs)
    assert [[c for c, x in zip(langs, s, strict=True) if x > 0.01] for s in share] == [langs, ["aa"], ["bb", "cc"]]
    assert np.allclose(share[0], 1 / 6, atol=0.02)


def plain_proportions(words: list[list[float]], k: int) -> list[float]:
    """The chosen shares of one document by plain loops; words: the log likelihood of each word in each language."""
    top = [max(w) for w in words]
    like = [[math.exp(max(x - t, -40)) for x in w] for w, t in zip(words, top, strict=True)]

    def estimate(share: list[float], rounds: int, floor: float) -> tuple[list[float], float]:
        rows = [[max(x, floor) for x in w] for w in like]
        for _ in range(rounds):
            parts = [[x * s for x, s in zip(w, share, strict=True)] for w in rows]
            share = [sum(p[i] / sum(p) for p in parts) / len(words) for i in range(k)]
        return share, sum(math.log(max(sum(x * s for x, s in zip(w, share, strict=True)), 1e-30)) for w in rows)

    one = [sum(w[i] for w in words) for i in range(k)]
    best, score = [float(i == one.index(max(one))) for i in range(k)], max(one)
    full, _ = estimate([1 / k] * k, language_id.ROUNDS, 0.0)
    order = sorted(range(k), key=lambda i: -full[i])
    penalty = 0.5 * math.log(max(len(words), 2))
    for size in range(2, k + 1):
        start = [max(full[i], 1e-4) if i in order[:size] else 0.0 for i in range(k)]
        share, logp = estimate([x / sum(start) for x in start], language_id.FEWER, 0.0 if size == k else 1e-30)
        if logp + sum(top) - (size - 1) * penalty > score:
            best, score = share, logp + sum(top) - (size - 1) * penalty
    return best


def test_mixtures_against_plain_loops():
    r = np.random.default_rng(7)
    logs = np.log(r.dirichlet(np.full(language_id.BUCKETS, 0.3), 3) + 1e-9).astype(np.float32)
    texts = ["abc def ghi", "aa", "the cat sat on the mat and the dog ran", " ".join(f"w{chr(97 + i % 26)}x" for i in range(60)), ""]
    got = language_id.proportions(*language_id.buffers(pa.array(texts)), logs)
    for text, share in zip(texts, got, strict=True):
        tri = language_id.trigrams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])) if text else []
        words, at = [], 0
        for w in text.split(" "):
            if w:
                words.append([float(sum(logs[i][tri[at + j]] for j in range(len(w)))) for i in range(3)])
            at += len(w) + 1
        want = plain_proportions(words, 3) if words else [0.0] * 3
        assert np.allclose(share, want, atol=2e-3)


def test_language_cases(spark):
    """A very long text, repeated rows, a tie, clashing columns, an empty table."""
    langs, logs = language_id.fit(spark.createDataFrame([("aaa bbb", "x"), ("aaa bbb", "y"), ("zzz qqq", "z")], "text string, lang string"))
    rows = [(1, "aaa " * 400_000), (2, "aaa bbb"), (2, "aaa bbb"), (3, "zzz"), (None, "qqq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS __lang", "'s' AS __score", "2 AS lang")
    out = language_id.with_languages(docs, langs, logs)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "__lang", "__score", "__langs"])
    got = [(r["doc_id"], r["__lang"]) for r in out.collect()]
    assert sorted(got, key=str) == [(1, "x"), (2, "x"), (2, "x"), (3, "z"), (None, "z")]
    assert language_id.with_languages(docs.limit(0), langs, logs).count() == 0


def test_matcher_against_a_naive_scan():
    """The longest pattern that starts at each word, and the words around it, whatever the gaps."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 6)))
    patterns = sorted({f" {word()}" for _ in range(20)} | {f" {word()} " for _ in range(20)})
    machine = toxicity.automaton(patterns)
    for _ in range(200):
        text = toxicity.folded((" " * r.choice([1, 2, 100])).join(word() for _ in range(r.randrange(12))))
        words = [(m.start(), m.group()) for m in re.finditer("[^ ]+", text)]
        want = set()
        for i, (at, _) in enumerate(words):
            fits = [p for p in patterns if text.startswith(p, at - 1)]
            if fits:
                want.add((patterns.index(max(fits, key=len)), at))
            assert toxicity.around(text, at) == (words[i - 1][1] if i else "", words[i][1], words[i + 1][1] if i + 1 < len(words) else "")
        assert set(toxicity.hits(machine, text, set())) == want
        excepted = {f"{a[1]} {b[1]}" for a, b in zip(words, words[1:], strict=False) if r.random() < 0.3}
        free = {(p, at) for p, at in want if not {f"{toxicity.around(text, at)[0]} {toxicity.around(text, at)[1]}", f"{toxicity.around(text, at)[1]} {toxicity.around(text, at)[2]}"} & excepted}
        assert set(toxicity.hits(machine, text, excepted)) == free


def test_toxicity_cases(spark, tmp_path):
    """No labels, null and repeated ids, null and very long texts, clashing columns; accuracy on rows held out."""
    r = random.Random(3)
    clean = lambda: " ".join("".join(r.choice("bdfgk") + r.choice("aeiou") for _ in range(3)) for _ in range(12))
    texts = [(i, clean() + (" you snarfler " if i % 4 == 0 else " ") + clean(), "x") for i in range(1200)]
    odd = [(None, "snarfler", "x"), (4000, None, "x"), (4001, "", "x"), (4002, "good " * 300_000, "x"), (5, "the snarfler", "x"), (5, clean(), "x")]
    for name, rows in (("full", [(i, int(i % 4 == 0)) for i in range(1200)] + [(None, 1), (4, None), (4000, 0)]), ("none", [])):
        spark.createDataFrame(texts + odd, "doc_id long, text string, __score string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = toxicity.op10_toxicity(spark, f"{tmp_path}/full").toPandas()
    assert len(got) == len(texts) + len(odd) and got.score.between(0, 1).all()
    out = got[got.held_out & (got.doc_id < 1200) & (got.doc_id != 5)]
    assert ((out.predicted == 1) == (out.doc_id % 4 == 0)).mean() > 0.98
    by = got.groupby("doc_id", dropna=False).predicted.agg(list)
    assert by[4000] == by[4001] == by[4002] == [0] and sorted(by[5]) == [0, 0, 1]
    assert (toxicity.op10_toxicity(spark, f"{tmp_path}/none").toPandas().score == 0).all()
    model = toxicity.Model([" snarf"], [5.0], set(), 10.0, 0.5)
    scored = toxicity.with_scores(spark.createDataFrame([("snarf", "a")], "text string, __score string"), model)
    assert scored.columns == ["text", "__score"] and scored.head()["__score"] > 0.7 and toxicity.with_scores(scored.limit(0), model).count() == 0


def test_preference_cases(spark):
    """An empty table, a table of pairs, long conversations."""
    schema = "conv_id long, turn long, role string, text string"
    assert chat_formatting.preference_segments(spark.createDataFrame([], schema)).count() == 0
    turns = [(c, i, "user" if i % 2 == 0 else "assistant", f"turn {i}" if i < 2990 else f"turn {i} of {c}") for c in (1, 2) for i in range(3000)]
    pairs = spark.createDataFrame([(9, 2, 1), (10, 1, 77), (11, 78, 79)], "pair_id long, chosen_id long, rejected_id long")
    got = chat_formatting.preference_segments(spark.createDataFrame(turns, schema), pairs).groupBy("pair_id", "part").count().collect()
    assert {(r["pair_id"], r["part"]): r["count"] for r in got} == {(9, "prompt"): 2990, (9, "chosen"): 10, (9, "rejected"): 10, (10, "chosen"): 3000}


def test_pipeline_cases(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing columns; an empty table; no benchmark."""
    import corpus_pipeline

    r = random.Random(6)
    text = lambda: " ".join(f"w{r.randrange(3000)}" for _ in range(80))
    a, b = text(), text()
    rows = [(1, a, "de", None), (2, a, None, "s"), (3, None, "de", "s"), (4, "", "de", "s"), (5, b, "de", "s"), (5, b, "de", "s"), (None, b, "de", "s"), (None, text(), None, None), (6, " ".join(b.split()[:60]) + " " + text(), "de", "s")]
    docs = spark.createDataFrame([(*x, 9, "i", 1, 2) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string, __kept int, term int")
    for name, table in (("some", docs), ("empty", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        spark.createDataFrame([("i", " ".join(a.split()[20:40]))] if name == "empty" else [], "item_id string, text string").write.mode("overwrite").parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert sorted(out.columns) == sorted(docs.columns)
    got = sorted((x["doc_id"] or 0 for x in out.collect()))
    assert got == [0, 1, 5, 5, 6] and next(len(x["text"].split()) for x in out.collect() if x["doc_id"] == 6) == 80
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0

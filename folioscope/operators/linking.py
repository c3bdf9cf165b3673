"""Entity linking: mentions, candidates, filters, triples."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions.models import Recogniser
from folioscope.operators.search import bm25, fuse, top

_QUOTES = str.maketrans({**dict(zip(X.CURLY, X.STRAIGHT, strict=True)), **dict.fromkeys(X.INVISIBLE), " ": " "})

# Kinds of names that are linked.
KINDS = ["PER", "ORG", "LOC"]


def mentions(docs: DataFrame, key: str, text: str, lang: str, default: Recogniser, by_lang: dict[str, Recogniser] | None = None) -> DataFrame:
    """(key, text, label): the names of the linked kinds in each row of docs, trimmed and each once, found by the recogniser of
    its language, or the default one. One pass without a shuffle; null texts and languages go to the recogniser as they
    are."""
    known = by_lang or {}

    def run(texts: pd.Series, langs: pd.Series) -> pd.Series:
        out: list = [[]] * len(texts)
        which = langs.where(langs.isin(list(known)), "").to_numpy()
        for name in set(which):
            at = [i for i, x in enumerate(which) if x == name]
            for i, names in zip(at, known.get(name, default)(texts.iloc[at]), strict=True):
                out[i] = names
        return pd.Series(out)

    found = F.pandas_udf(run, "array<struct<text:string,label:string>>")
    named = docs.select(F.col(key), found(text, lang).alias("x"))
    once = F.array_distinct(F.transform("x", lambda x: F.struct(F.trim(x["text"]).alias("text"), x["label"].alias("label"))))
    return named.select(key, F.explode(once).alias("x")).select(key, "x.*").filter(F.col("label").isin(KINDS) & (F.col("text") != ""))


def _pieces(length: Column, share: float) -> Column:
    """Where to cut a word so that of any word within the share of edits, one piece at least is left whole: one piece more
    than there can be edits. Structs of a piece's number, start, width, and the edits."""
    edits = F.floor(length * (2 * share / (1 - share)) + 1e-9).cast("int")
    edge = lambda i: F.floor(i * length / (edits + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), edits), lambda i: F.struct(i.alias("i"), edge(i).alias("at"), (edge(i + 1) - edge(i)).alias("width"), edits.alias("edits")))


def _piece(word: Column, length: Column, p: Column, at: Column) -> Column:
    return F.struct(length.alias("length"), p["i"].alias("i"), F.substring(word, at + 1, p["width"]).alias("piece"))


def alike(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """(a, b): words a of left and b of right whose ratio is least at least, case aside. Words meet by pieces: b is cut, and a
    is looked through for each piece near its place, for each length that b can have. Nothing is broadcast, and no word
    meets all others."""
    share = 1 - (least - 0.5) / 100  # ratios are rounded
    b = F.lower("b")
    cut = right.select("b", F.explode(F.transform(_pieces(F.length(b), share), lambda p: _piece(b, F.length(b), p, p["at"]))).alias("key"))
    a, n = F.lower("a"), F.length(F.lower("a"))

    def places(m: Column, p: Column) -> Column:
        first = F.greatest(p["at"] - p["edits"], F.lit(0))
        last = F.greatest(first, F.least(p["at"] + p["edits"], n - p["width"]))
        return F.transform(F.sequence(first, last), lambda at: _piece(a, m, p, at))

    lengths = F.sequence(F.ceil(n * ((1 - share) / (1 + share)) - 1e-9).cast("int"), F.floor(n * ((1 + share) / (1 - share)) + 1e-9).cast("int"))
    looked = F.flatten(F.transform(lengths, lambda m: F.flatten(F.transform(_pieces(m, share), lambda p: places(m, p)))))
    met = left.select("a", F.explode(F.array_distinct(looked)).alias("key")).join(cut, "key").select("a", "b").distinct()
    return met.filter(X.ratio(a, b) >= least)


def reduce_mentions(names: DataFrame, name: str, least: int = 85) -> DataFrame:
    """Full names, and single words that no full name's last word resembles; each once."""
    clean = names.select(F.trim(name).alias(name)).filter(F.col(name) != "").distinct()
    many = F.size(F.split(F.col(name), X.SPACES)) > 1
    full, single = clean.filter(many), clean.filter(~many)
    last = full.select(X.last_word(F.col(name)).alias("b")).distinct()
    resembling = alike(single.select(F.col(name).alias("a")), last, least).select(F.col("a").alias(name))
    return full.unionByName(single.join(resembling, name, "left_anti"))


def candidates(mentions: DataFrame, entities: DataFrame, k: int = 8, least_score: float = 0.4, least_fuzzy: int = 75) -> DataFrame:
    """(mention, id, name, score, fuzzy): of each mention, the k entities that share most words with it, then those with a
    score above the bound and enough fuzzy likeness. Mentions and entities meet by shared words, not all with all."""
    asked = mentions.select("mention", X.terms(F.col("mention")).alias("w"))
    asked = asked.select("mention", F.size("w").alias("size"), F.explode(F.array_distinct("w")).alias("term"))
    known = entities.select("id", "name", F.explode(F.array_distinct(X.terms(F.col("name")))).alias("term"))
    shared = asked.join(known, "term").groupBy("mention", "size", "id", "name").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.withColumn("score", F.round(F.col("shared") / F.col("size"), 6))
    best = top(scored, ["mention"], [F.desc("score"), F.col("id")], k).withColumn("fuzzy", X.token_sort_ratio(F.col("name"), F.col("mention")))
    return best.filter((F.col("score") > least_score) & (F.col("fuzzy") >= least_fuzzy)).select("mention", "id", "name", "score", "fuzzy")


def trigrams(name: Column) -> Column:
    """The distinct runs of three characters of a lower-case name between spaces."""
    padded = F.concat(F.lit(" "), F.lower(F.trim(name)), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, 3)))


def hybrid_candidates(mentions: DataFrame, entities: DataFrame, k: int = 8, alpha: float = 0.25) -> DataFrame:
    """(mention, kind, id, score, rank): of each mention the k entities of its kind with the best fused score. mentions:
    mention, kind; entities: id, kind, name. The vector side is the cosine of trigram sets, so that other spellings are
    found; mentions and entities meet by shared trigrams in an inverted index, which all pairs above zero do. The keyword
    side is BM25 over all names."""
    qid = F.concat_ws("", "kind", "mention")
    asked = mentions.select("mention", "kind").distinct().withColumn("qid", qid)
    a = asked.select("qid", "kind", trigrams(F.col("mention")).alias("g")).select("qid", "kind", F.size("g").alias("na"), F.explode("g").alias("gram"))
    b = entities.select("id", "kind", trigrams(F.col("name")).alias("g")).select("id", "kind", F.size("g").alias("nb"), F.explode("g").alias("gram"))
    shared = a.join(b, ["kind", "gram"]).groupBy("qid", "id", "na", "nb").agg(F.count(F.lit(1)).alias("n"))
    near = shared.select("qid", "id", F.round(F.col("n") / F.sqrt(F.col("na") * F.col("nb")), 6).alias("cos"))
    words = bm25(asked.select("qid", F.col("mention").alias("query")), entities, "id", "name").join(near.select("qid", "id"), ["qid", "id"], "left_semi")
    fused = fuse(near, words, "id", alpha, asked).withColumn("score", F.round("score", 4))
    return top(fused, ["qid"], [F.desc("score"), F.col("id")], k).join(asked, "qid").select("mention", "kind", "id", "score", "rank")


def linked(mentions: DataFrame, entities: DataFrame, lang: str = "de", k: int = 8, least_score: float = 0.75, least_fuzzy: int = 80, days: int = 7300) -> DataFrame:
    """(mention, kind, date, id, url, shown, names, score, fuzzy): hybrid_candidates, of which those stay whose displayed name is
    enough like the mention, who were alive, if people, on the mention's date, and whose score is above the bound.
    mentions: mention, kind, date; entities: id, kind, type, url, name, name_de, name_fr, name_it, birth, death."""
    given = {x: F.col(f"name_{x}") for x in ("de", "fr", "it")}
    local = F.when(F.col("type") == "District", F.col("name_de")).otherwise(display_name(F.col("kind"), lang, given | {"name": F.col("name")}))
    names = F.when(F.col("kind") == "ORG", F.array(F.concat_ws(", ", "name_de", "name_fr"))).otherwise(F.array_compact(F.array(*(c for c in named(entities)))))
    known = entities.select("id", "kind", local.alias("shown"), names.alias("names"), "url", "birth", "death")
    searched = known.select("id", "kind", F.coalesce("shown", F.lit("")).alias("name"))
    found = hybrid_candidates(mentions, searched, k).join(known, ["id", "kind"]).join(mentions, ["mention", "kind"])
    found = found.withColumn("fuzzy", X.token_sort_ratio(F.lower("mention"), F.lower(F.coalesce("shown", F.lit("")))))
    lived = (F.col("kind") != "PER") | alive("birth", "death", F.col("date"), days)
    return found.filter((F.col("fuzzy") >= least_fuzzy) & lived & (F.col("score") > least_score)).select("mention", "kind", "date", "id", "url", "shown", "names", "score", "fuzzy")


def named(df: DataFrame, part: str = "name") -> list[Column]:
    """The columns whose name has part in it."""
    return [F.col(f"`{c}`") for c in df.columns if part in c]


def counts(links: DataFrame, document: str, part: str, kind: str = "kind") -> DataFrame:
    """(document, part, kind, n): links of each kind by part, and by document (part null)."""
    rows = links.groupBy(document, part, kind).agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(rows.groupBy(document, kind).agg(F.sum("n").alias("n")).withColumn(part, F.lit(None).cast(dict(rows.dtypes)[part])))


def alive(birth: Column | str | None, death: Column | str, date: Column, days: int = 7300) -> Column:
    """Whether someone can be meant on a date: not if they died, on 1 January of the year given, more than the days before
    it, nor if they were born less than the days before it (without birth: whenever they were born). Years may end in .0; what is no year excludes nothing."""
    day = lambda y: F.make_date(F.expr(f"try_cast(split_part({_sql(y)}, '.', 1) AS int)"), F.lit(1), F.lit(1))
    bound = F.date_sub(date, days)
    dead = F.coalesce(day(death) >= bound, F.lit(True))
    return dead if birth is None else dead & F.coalesce(day(birth) <= bound, F.lit(True))


def _sql(c: Column | str) -> str:
    return c if isinstance(c, str) else c._jc.toString()


def display_name(kind: Column, lang: str, names: dict[str, Column]) -> Column:
    """A person's name; an organisation's French name for fr, else the German; a place's name in the language, else the
    German."""
    org = names["fr"] if lang == "fr" else names["de"]
    return F.when(kind == "PER", names["name"]).when(kind == "ORG", org).otherwise(F.coalesce(names.get(lang, names["de"]), names["de"]))


def parsed_answer(raw: str | None) -> list[dict[str, str]] | None:
    """The people of a model's raw answer: the first balanced object, cleaned, parsed, entries without url removed. Without
    an object it is None; ValueError if the object can't be parsed or has no people."""
    depth = start = 0
    for at, ch in enumerate(raw or ""):
        if ch == "{":
            start = at if depth == 0 else start
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth == 0:
                break
    else:
        return None
    text = raw[start : at + 1].translate(_QUOTES)
    text = re.sub(r",(\s*[}\]])", r"\1", text)
    for word, name in (("None", "null"), ("True", "true"), ("False", "false")):
        text = re.sub(rf"\b{word}\b", name, text)
    found = json.loads(text)
    if not isinstance(found, dict) or not isinstance(found.get("people"), list):
        raise ValueError("the answer has no people")
    return [x for x in found["people"] if isinstance(x, dict) and x.get("url")]


def asking(client: Callable[[str], str | None]) -> Judge:
    """A judge that asks a language model: client takes a prompt and gives a raw answer. plausible calls it again where the
    answer can't be parsed."""

    def judge(candidates: list[dict[str, str]], text: str) -> list[dict[str, str]] | None:
        return parsed_answer(client(json.dumps({"text": text, "people": candidates}, ensure_ascii=False)))

    return judge


Judge = Callable[[list[dict[str, str]], str], list[dict[str, str]] | None]


def plausible(candidates: DataFrame, texts: DataFrame, judge: Judge, calls: int = 4) -> DataFrame:
    """Candidates (part, kind, url, description) that stay once a judge has read each part's text (part, text) with its people.

    Of the people those with an accepted url stay, beside the part's organisations and places. A part without people isn't
    asked about and keeps all. A judge that raises ValueError is called again, up to the calls in all; one that still does,
    or that gives None, costs the part all its candidates. A missing or null text is empty; people without url go. A null
    part is in none. The judge gets the distinct people of one part at a time, which candidate search bounds; candidates
    meet the verdicts by part and are not gathered."""
    people = candidates.filter((F.col("kind") == "PER") & F.col("part").isNotNull()).groupBy("part").agg(F.array_sort(F.collect_set(F.struct("url", "description"))).alias("people"))
    asked = people.join(texts.filter(F.col("part").isNotNull()).groupBy("part").agg(F.min("text").alias("text")), "part", "left")

    def answer(rows: list, text: str | None) -> list[str] | None:
        for _ in range(calls):
            try:
                found = judge([{"url": r["url"] or "", "description": r["description"] or ""} for r in rows], text or "")
            except ValueError:
                continue
            return None if found is None else [x["url"] for x in found if x.get("url")]
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"part": pdf["part"], "accepted": [answer(p, t) for p, t in zip(pdf["people"], pdf["text"], strict=True)]})

    verdicts = asked.mapInPandas(run, f"part {dict(people.dtypes)['part']}, accepted array<string>").select(F.col("part").alias("__part"), F.col("accepted").alias("__accepted"), F.lit(True).alias("__asked"))
    both = candidates.filter(F.col("part").isNotNull()).join(verdicts, F.col("part") == F.col("__part"), "left")
    stays = F.col("__asked").isNull() | (F.col("__accepted").isNotNull() & ((F.col("kind") != "PER") | F.array_contains("__accepted", F.col("url"))))
    return both.filter(stays).drop("__part", "__accepted", "__asked")


# Predicates of links and what an entity's address must contain.
HAS_PLACE, HAS_SUBJECT = "rico:hasPlace", "rico:hasSubject"


def link_triples(links: DataFrame, allowed: dict[str, str], base: str = "urn:part:") -> DataFrame:
    """(subject, predicate, object) of links (part, kind, url) whose url has what its kind allows."""
    ok = F.lit(False)
    for kind, needle in allowed.items():
        ok = ok | ((F.col("kind") == kind) & F.contains("url", F.lit(needle)))
    predicate = F.when(F.col("kind") == "LOC", HAS_PLACE).otherwise(HAS_SUBJECT)
    return links.filter(ok).select(F.concat(F.lit(base), F.col("part")).alias("subject"), predicate.alias("predicate"), F.col("url").alias("object"))

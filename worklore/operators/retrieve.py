"""Lookups over the record store: exact anchors, timelines and ranked keyword search, in one repository or several."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklore.functions.expressions import let
from worklore.functions.predicates import is_dead_end
from worklore.operators.store import MARKED, PLAIN, live

# What a match of each kind, and a dead end, add to a score; the span of the recency bonus; BM25's constants.
WEIGHTS = {"file": 50.0, "route": 45.0, "symbol": 40.0, "setting": 45.0, "issue": 30.0, "branch": 10.0, "commit": 10.0}
TEXT_WEIGHT, DEAD_END_BOOST, RECENCY = 5.0, 40.0, 10.0
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
NEAR_DISTANCE = 10


def weight(kind: Column) -> Column:
    out = F.lit(TEXT_WEIGHT)
    for k, w in WEIGHTS.items():
        out = F.when(kind == k, w).otherwise(out)
    return out


def rank(matches: DataFrame, records: DataFrame, include_inferred: bool = False, by: str = "created_at", carry: tuple[str, ...] = ()) -> DataFrame:
    """matches(id, kind) -> live records with score and matched kinds, and the greatest of each column in `carry`. The recency bonus spreads the candidates between
    the oldest and newest `by`; with the default it compares occurred_at to bounds of created_at, and isn't bounded."""
    grouped = matches.groupBy("id").agg(F.sum(weight(F.col("kind"))).alias("_weight"), F.sort_array(F.collect_set("kind")).alias("matched"), *(F.max(c).alias(c) for c in carry))
    hits = live(records, include_inferred).join(grouped, "id")
    at = lambda c: F.unix_micros(c) / 1e6
    bounds = hits.agg(F.max(at(by)).alias("_new"), F.min(at(by)).alias("_old"))
    # one row, joined by a constant key
    hits = hits.withColumn("_k", F.lit(1)).join(bounds.withColumn("_k", F.lit(1)), "_k").drop("_k")
    bonus = F.when(F.col("_new") > F.col("_old"), (at("occurred_at") - F.col("_old")) / (F.col("_new") - F.col("_old")) * RECENCY).otherwise(0.0)
    dead = F.when(is_dead_end(F.col("kind"), F.col("outcome"), F.col("evidence")), DEAD_END_BOOST).otherwise(0.0)
    return hits.withColumn("score", F.col("_weight") + dead + bonus).drop("_weight", "_new", "_old")


def ranked(hits: DataFrame) -> DataFrame:
    return hits.orderBy(F.col("score").desc(), F.col("occurred_at").desc(), "id")


def by_anchor(records: DataFrame, anchors: DataFrame, kind: str, value: str, include_inferred: bool = False) -> DataFrame:
    found = anchors.where((F.col("kind") == kind) & (F.col("value") == value)).select(F.col("record_id").alias("id"), "kind")
    return ranked(rank(found, records, include_inferred))


def timeline(records: DataFrame, anchors: DataFrame, path: str, include_inferred: bool = False) -> DataFrame:
    """Records that touch a file, oldest first."""
    return by_anchor(records, anchors, "file", path, include_inferred).orderBy("occurred_at", F.col("score").desc(), "id")


class QueryError(ValueError):
    pass


TOKEN = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")(?P<qstar>\*)?|(?P<word>[\w\u0080-￿]+)(?P<star>\*)?|(?P<mark>[():^+,]))', re.UNICODE)


def parse_query(text: str) -> tuple:
    """A query as nested tuples: ('and'|'or'|'not', left, right), ('near', distance, phrases…) and ('terms', words, field,
    prefix, first). Bare words side by side are joined by and; NOT binds tighter than AND, and AND than OR. What isn't
    well-formed raises QueryError."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"can't read {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    pos = 0

    def peek(kind: str) -> str | None:
        return tokens[pos][kind] if pos < len(tokens) else None

    def split(s: str) -> list[str]:
        return [w for w in re.split(r"[^\w]|_", s.lower().translate(str.maketrans(MARKED, PLAIN))) if w]

    def phrase(field: str | None) -> tuple:
        nonlocal pos
        if peek("mark") == "(":
            pos += 1
            inner = either(field)
            if peek("mark") != ")":
                raise QueryError("a parenthesis isn't closed")
            pos += 1
            return inner
        if peek("word") == "NEAR" and pos + 1 < len(tokens) and tokens[pos + 1]["mark"] == "(":
            pos += 2
            return near(field)
        first = peek("mark") == "^"
        pos += first
        if pos >= len(tokens) or tokens[pos]["mark"]:
            raise QueryError("a term is missing")
        m = tokens[pos]
        pos += 1
        if m["word"] and peek("mark") == ":":
            pos += 1
            return phrase(m["word"].lower())
        words = split(m["quoted"][1:-1].replace('""', '"') if m["quoted"] else m["word"])
        while peek("mark") == "+":
            pos += 1
            if pos >= len(tokens) or tokens[pos]["mark"]:
                raise QueryError("a term is missing")
            words += split((tokens[pos]["quoted"] or tokens[pos]["word"]).strip('"'))
            pos += 1
        return ("terms", tuple(words), field, bool(m["qstar"] or m["star"]), first)

    def near(field: str | None) -> tuple:
        """What stands in NEAR(…): phrases, and after a comma how many words may be between the first and the last."""
        nonlocal pos
        phrases, distance = [], NEAR_DISTANCE
        while pos < len(tokens) and tokens[pos]["mark"] not in (")", ",", "("):
            phrases.append(phrase(field))
        if peek("mark") == ",":
            if pos + 1 >= len(tokens) or not (tokens[pos + 1]["word"] or "").isdigit():
                raise QueryError("NEAR's distance is missing")
            distance = int(tokens[pos + 1]["word"])
            pos += 2
        if peek("mark") != ")" or not phrases:
            raise QueryError("NEAR isn't closed")
        pos += 1
        return phrases[0] if len(phrases) == 1 else ("near", distance, *phrases)

    def operator(name: str) -> bool:
        return peek("word") == name and pos + 1 < len(tokens)

    def without(field: str | None) -> tuple:
        nonlocal pos
        left = phrase(field)
        while operator("NOT"):
            pos += 1
            left = ("not", left, phrase(field))
        return left

    def all_of(field: str | None) -> tuple:
        nonlocal pos
        left = without(field)
        while pos < len(tokens) and peek("mark") != ")" and not operator("OR"):
            if operator("AND"):
                pos += 1
            left = ("and", left, without(field))
        return left

    def either(field: str | None) -> tuple:
        nonlocal pos
        left = all_of(field)
        while operator("OR"):
            pos += 1
            left = ("or", left, all_of(field))
        return left

    if not tokens:
        raise QueryError("the query is empty")
    tree = either(None)
    if pos < len(tokens):
        raise QueryError("text is left over")
    return tree


def leaves(tree: tuple) -> list[tuple]:
    if tree[0] == "terms":
        return [tree]
    return [leaf for part in tree[2 if tree[0] == "near" else 1 :] for leaf in leaves(part)]


def _padded(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _holds(leaf: tuple, fields: dict[str, Column]) -> Column:
    _, words, field, prefix, first = leaf
    text = " ".join(words) + ("" if prefix else " ")
    if not words:
        return F.lit(False)
    chosen = [fields[field]] if field in fields else list(fields.values())
    tests = [F.startswith(_padded(c), F.lit(" " + text)) if first else F.contains(_padded(c), F.lit(" " + text)) for c in chosen]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _satisfies(tree: tuple, fields: dict[str, Column]) -> Column:
    if tree[0] == "terms":
        return _holds(tree, fields)
    if tree[0] == "near":
        out = F.lit(False)
        for name, c in fields.items():
            if all(leaf[2] in (None, name) or leaf[2] not in fields for leaf in tree[2:]):
                # bound, since a filter is pushed below the words' own projection and would split the text at each word
                out = out | let(c, lambda w: _close(tree[1], tree[2:], w))
        return out
    left, right = _satisfies(tree[1], fields), _satisfies(tree[2], fields)
    return left & right if tree[0] == "and" else left | right if tree[0] == "or" else left & ~right


def _close(distance: int, phrases: tuple, c: Column) -> Column:
    """Whether a field's words hold all phrases with at most `distance` words from the end of the first to the start of the
    last of them."""

    def clump(places: list[Column], reach: int):
        def holds(a: Column) -> Column:
            out = F.lit(True)
            for other in places:
                out = out & F.exists(other, lambda t: (t >= a) & (t <= a + reach))
            return out

        return holds

    def bound(places: list[Column]) -> Column:
        if len(places) < len(phrases):  # each phrase's places are worked out once
            return let(_starts(phrases[len(places)], c), lambda p: bound([*places, p]))
        out = F.lit(False)
        for leaf, mine in zip(phrases, places, strict=True):
            out = out | F.exists(mine, clump(places, len(leaf[1]) + distance))
        return out

    return bound([])


def _starts(leaf: tuple, c: Column) -> Column:
    """Where a phrase begins."""
    _, words, _, prefix, first = leaf
    every = F.filter(F.transform(c, lambda x, i: F.when(_run(c, i, words, prefix), i).otherwise(-1)), lambda i: i >= 0)
    return F.filter(every, lambda i: i == 0) if first else every


def _frequency(leaf: tuple, fields: dict[str, Column]) -> Column:
    """Occurrences of a phrase in all fields."""
    _, words, field, prefix, _ = leaf
    n = len(words)
    same = lambda x, i, last: F.startswith(x, F.lit(words[i])) if prefix and last else x == words[i]
    out = F.lit(0)
    for c in [fields[field]] if field in fields else list(fields.values()):
        if n == 1:
            out = out + F.size(F.filter(c, lambda x: same(x, 0, True)))
        elif n:
            out = out + let(c, lambda w: F.size(F.filter(F.transform(w, lambda x, i: _run(w, i, words, prefix)), lambda ok: ok)))
    return out


def _run(c: Column, i: Column, words: tuple[str, ...], prefix: bool) -> Column:
    out = F.lit(True)
    for k, w in enumerate(words):
        x = F.get(c, i + k)
        out = out & F.coalesce(F.startswith(x, F.lit(w)) if prefix and k == len(words) - 1 else x == w, F.lit(False))
    return out


def bm25(docs: DataFrame, query: str, limit: int, fields: tuple[str, ...] = ("summary", "detail", "anchor_text"), totals: tuple[int, float] | None = None) -> DataFrame:
    """The `limit` best of docs(record_id, fields…) for a query: (id, bm25), larger being better. A phrase counts as one
    term. Corpus counts are one pass of sums; the ranking is a top-k. A malformed query finds nothing. With totals (number of
    records, mean length) of a larger corpus, docs need only hold its records that hold some word of the query."""
    from worklore.operators.store import terms

    try:
        tree = parse_query(query)
    except QueryError:
        return docs.select(F.col("record_id").alias("id"), F.lit(0.0).alias("bm25")).limit(0)
    phrases = list(dict.fromkeys(leaves(tree)))
    t = docs.select("record_id", *(terms(F.col(f)).alias(f) for f in fields))
    cols = {f: F.col(f) for f in fields}
    length = F.lit(0)
    for f in fields:
        length = length + F.size(f)
    t = t.select("record_id", length.alias("dl"), _satisfies(tree, cols).alias("ok"), *(_frequency(p, cols).alias(f"tf{i}") for i, p in enumerate(phrases)))
    return _best(t, len(phrases), limit, totals)


def _best(t: DataFrame, n: int, limit: int, totals: tuple[int, float] | None) -> DataFrame:
    """The best of t(record_id, dl, ok, tf0…), by two passes: sums, then the top."""
    stats = t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(n))).first()
    count, mean = totals or (stats["n"], stats["avgdl"])
    score = F.lit(0.0)
    for i in range(n):
        tf = F.col(f"tf{i}")
        score = score + F.when(tf > 0, idf(count, stats[f"df{i}"]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean or 1))))).otherwise(0.0)
    return t.where("ok").select(F.col("record_id").alias("id"), score.alias("bm25")).orderBy(F.col("bm25").desc(), "id").limit(limit)


def idf(n: int, df: int) -> float:
    return max(LEAST_IDF, math.log((n - df + 0.5) / (df + 0.5))) if n else 0.0


def bm25_indexed(docs: DataFrame, postings: DataFrame, totals: tuple[int, float], query: str, limit: int, fields: tuple[str, ...] = ("summary", "detail", "anchor_text")) -> DataFrame:
    """As `bm25`, from postings(record_id, term, tf, dl): only those of the query's words are read. Plain words need nothing
    else; for phrases, prefixes, fields and places the texts of the records that hold the words are read."""
    try:
        tree = parse_query(query)
    except QueryError:
        return bm25(docs, query, limit, fields)
    phrases = list(dict.fromkeys(leaves(tree)))
    if all(len(p[1]) == 1 and p[2] not in fields and not p[3] and not p[4] for p in phrases) and not _has_near(tree):
        words = [p[1][0] for p in phrases]
        met = postings.where(F.col("term").isin(*words)).groupBy("record_id").agg(F.first("dl").alias("dl"), *(F.sum(F.when(F.col("term") == w, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, w in enumerate(words)))
        held = {p: F.col(f"tf{i}") > 0 for i, p in enumerate(phrases)}
        return _best(met.withColumn("ok", _by_words(tree, held)), len(words), limit, totals)
    some = F.lit(False)
    for _, words, _, prefix, _ in phrases:
        for k, w in enumerate(words):
            some = some | (F.startswith("term", F.lit(w)) if prefix and k == len(words) - 1 else F.col("term") == w)
    return bm25(docs.join(postings.where(some).select("record_id").distinct(), "record_id", "left_semi"), query, limit, fields, totals)


def _has_near(tree: tuple) -> bool:
    return tree[0] == "near" or tree[0] != "terms" and any(map(_has_near, tree[1:]))


def _by_words(tree: tuple, held: dict[tuple, Column]) -> Column:
    if tree[0] == "terms":
        return held[tree]
    left, right = _by_words(tree[1], held), _by_words(tree[2], held)
    return left & right if tree[0] == "and" else left | right if tree[0] == "or" else left & ~right


def ranked_by_text(found: DataFrame, records: DataFrame, include_inferred: bool = False) -> DataFrame:
    """found(id, bm25) -> live records with score and bm25, which goes through the ranking as a column."""
    return rank(found.select("id", F.lit("text").alias("kind"), "bm25"), records, include_inferred, carry=("bm25",))


def search(records: DataFrame, docs: DataFrame, query: str, include_inferred: bool = False, limit: int = 50) -> DataFrame:
    """Keyword search: the best `limit` by BM25, of which live ones are ranked. Filters come after the limit."""
    return ranked(ranked_by_text(bm25(docs, query, limit), records, include_inferred))


def across(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Hits of several repositories, each with its repository's name if there is more than one."""
    out = None
    for name, hits in parts:
        tagged = hits.withColumn("repo", F.lit(name if len(parts) > 1 else ""))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def timeline_across(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    return across(parts).orderBy("occurred_at", "repo", "id")


def by_anchor_across(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    return across(parts).orderBy("occurred_at", "repo", "id")


def search_across(parts: list[tuple[str, DataFrame]], limit: int = 50) -> DataFrame:
    """Scores are of each repository; the merged hits are ranked and cut again."""
    return across(parts).orderBy(F.col("score").desc(), F.col("occurred_at").desc(), "repo", "id").limit(limit)


def setting_history(records: DataFrame, anchors: DataFrame, key: str, order_by: str = "created_at") -> DataFrame:
    return by_anchor(records, anchors, "setting", key).orderBy(order_by, "id")


def with_anchors(records: DataFrame, anchors: DataFrame) -> DataFrame:
    """Records with their anchors grouped again by kind, values in order."""
    kinds = ("file", "route", "symbol", "setting", "commit", "issue", "branch")
    grouped = anchors.groupBy("record_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("value")))).alias(f"{k}_anchors") for k in kinds))
    return records.join(grouped.withColumnRenamed("record_id", "id"), "id", "left")

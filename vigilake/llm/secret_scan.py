"""Secret scans over a trigram inverted index, in Spark SQL only.

Each rule's regular expression is turned into a Boolean query over trigrams (an OR of ANDs) that any match must
satisfy.  The index holds postings (trigram, document) for the trigrams that some query names.  Postings that a
query's conjunction needs are intersected by counting; what is left are candidates, which are verified with the
expression itself.  A rule whose query is empty (hex runs) scans every text.

Spans come from the pieces that a split leaves between matches: running sums of their lengths are the matches'
code-point positions.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.scratch import quoted, unused


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, non-overlapping) whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Fixed values of the contract: kinds, their order, expressions and least lengths.
BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ that are long enough
]
# Shapes of widely used credentials that the base kinds don't cover.
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
]
ANY = [frozenset()]  # the query that every text satisfies
_MOST = 64


# --- queries from expressions ------------------------------------------------------------------------------


def _least(dnf: list[frozenset]) -> list[frozenset]:
    """Without conjunctions that another one implies."""
    out: list[frozenset] = []
    for c in sorted(set(dnf), key=lambda c: (len(c), sorted(c))):
        if not any(d <= c for d in out):
            out.append(c)
    return out


def _both(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
    if len(a) * len(b) > _MOST:
        return a if min(map(len, a)) >= min(map(len, b)) else b
    return _least([x | y for x in a for y in b])


def _grams(strings: set[str]) -> list[frozenset]:
    return _least([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _read(nodes) -> tuple[set[str] | None, list[frozenset]]:
    """(all strings that the nodes match, or None if they are too many; the query of the rest)."""
    now: set[str] | None = {""}
    query = ANY

    def then(strings: set[str] | None, more: list[frozenset]) -> None:
        nonlocal now, query
        query = _both(query, more)
        if strings is not None and now is not None and len(now) * len(strings) <= _MOST:
            now = {a + b for a in now for b in strings}
            return
        if now is not None:
            query = _both(query, _grams(now))
        now = strings

    whole = True
    for op, arg in nodes:
        if op is sre.LITERAL:
            then({chr(arg).lower()}, ANY)
        elif op is sre.IN:
            chars = _class(arg)
            whole &= chars is not None
            then(chars, ANY)
        elif op is sre.SUBPATTERN:
            strings, more = _read(arg[3])
            whole &= strings is not None
            then(strings, more)
        elif op is sre.BRANCH:
            each = [_read(x) for x in arg[1]]
            if all(s is not None and q == ANY for s, q in each) and sum(len(s) for s, _ in each) <= _MOST:
                then(set().union(*[s for s, _ in each]), ANY)
            else:
                whole = False
                then(None, _least([c for s, q in each for c in (_both(q, _grams(s)) if s is not None else q)]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            strings, more = _read(body)
            if strings is not None and more == ANY and high == 1 and low == 0:
                then(strings | {""}, ANY)
            elif strings is not None and more == ANY and low == high and len(strings) == 1:
                then({next(iter(strings)) * low}, ANY)
            else:
                whole = False
                then(None, (_both(more, _grams(strings)) if strings is not None else more) if low else ANY)
        elif op is not sre.AT:
            whole = False
            then(None, ANY)
    if whole and now is not None:
        return now, query
    if now is not None:
        query = _both(query, _grams(now))
    return None, query


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 16:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def trigram_query(pattern: str) -> list[frozenset]:
    """An OR of ANDs of lower-case trigrams that every text matching ``pattern`` satisfies; [empty] if none is known."""
    strings, query = _read(sre_parser.parse(pattern))
    if strings is not None:
        query = _both(query, _grams(strings))
    return _least(query)


# --- scan --------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): id and a hash of the text tell documents apart; rows that share both are copies."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, id, h): which of ``trigrams`` each text holds, in lower case."""
    low = keyed.select("id", "h", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))
    return low.select("id", "h", F.explode(held).alias("trigram"))


def candidates(keyed: DataFrame, queries: dict[str, list[frozenset]]) -> DataFrame:
    """(id, h, kinds): documents that satisfy the query of each of ``kinds``, from intersected postings."""
    terms = [(kind, k, t, len(c)) for kind, dnf in queries.items() for k, c in enumerate(dnf) for t in sorted(c)]
    needs = keyed.sparkSession.createDataFrame(terms, "kind string, k int, trigram string, n int")  # as many rows as the rules have trigrams
    found = postings(keyed, sorted({t for _, _, t, _ in terms})).join(F.broadcast(needs), "trigram")
    whole = found.groupBy("id", "h", "kind", "k").agg(F.count_distinct("trigram").alias("got"), F.first("n").alias("n")).filter("got = n")
    return whole.groupBy("id", "h").agg(F.collect_set("kind").alias("kinds"))


def _pieces(rule: Rule) -> Column:
    """array<struct<gap, n, ok>>: for each match, the characters since the last one, its own, and whether it counts."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    found = F.zip_with(whole, group, lambda m, g: F.struct(F.length(m).alias("n"), (F.length(g) >= rule.least).alias("ok")))
    gaps = F.zip_with(F.split(text, rule.pattern, -1), found, lambda p, m: F.struct(F.length(p).alias("gap"), m["n"].alias("n"), m["ok"].alias("ok")))
    return F.when(text.rlike(rule.pattern), gaps)


def _hits(rows: DataFrame, rules: list[tuple[int, Rule]], guard: bool) -> DataFrame:
    """(id, h, ord, kind, pieces) of the rules that match; ``guard``: only rules named in ``kinds``."""
    each = []
    for order, r in rules:
        pieces = F.when(F.array_contains("kinds", r.kind), _pieces(r)) if guard else _pieces(r)
        each.append(F.struct(F.lit(order).alias("ord"), F.lit(r.kind).alias("kind"), pieces.alias("pieces")))
    return rows.select("id", "h", F.explode(F.array(*each)).alias("r")).select("id", "h", "r.*").filter("pieces is not null")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """(id, h, spans): the distinct documents that hold secrets; spans is array<struct<start, ord, end, kind>>, sorted.

    ``h`` is xxhash64 of the text (null as empty).
    """
    rules = [*BASE, *MORE] if rules is None else rules
    keyed = _keyed(docs, id_col, text_col)
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = [(i, r) for i, r in enumerate(rules) if asked[r.kind] != ANY]
    scanned = [(i, r) for i, r in enumerate(rules) if asked[r.kind] == ANY]
    hits = []
    if scanned:
        hits.append(_hits(keyed, scanned, False))
    if indexed:
        queries = {r.kind: asked[r.kind] for _, r in indexed}
        # one trigram of each conjunction, so that only texts that could be candidates are dealt out to meet them
        some = sorted({min(c, key=lambda t: (sum(t in d for q in queries.values() for d in q), t)) for q in queries.values() for c in q})
        low = F.lower("text")
        maybe = keyed.filter(_any(low, some))
        found = candidates(keyed, queries).withColumnRenamed("id", "id2").withColumnRenamed("h", "h2")
        hits.append(_hits(maybe.join(found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))), indexed, True))
    rows = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
    once = rows.groupBy("id", "h", "ord", "kind").agg(F.first("pieces").alias("pieces"))  # copies of a row have the same
    w = Window.partitionBy("id", "h", "ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = once.select("id", "h", "ord", "kind", F.posexplode("pieces").alias("pos", "p")).filter("p.n is not null")
    at = at.withColumn("stop", F.sum(F.col("p.gap") + F.col("p.n")).over(w)).filter("p.ok")
    span = F.struct((F.col("stop") - F.col("p.n")).alias("start"), "ord", F.col("stop").alias("end"), "kind")
    return at.groupBy("id", "h").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def _any(low: Column, some: list[str]) -> Column:
    out = F.lit(False)
    for t in some:
        out = out | low.contains(t)
    return out


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans), one row per row of ``docs``.

    A null text counts as empty; texts without secrets have zero counts, the digest of nothing and no spans.
    Repeated rows each get their result; ids may be null or repeat.  Other columns are ignored.
    """
    found = find_spans(docs, id_col, text_col).withColumnRenamed("id", "id2").withColumnRenamed("h", "h2")
    rows = _keyed(docs, id_col, text_col).select("id", "h")
    out = rows.join(found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string>>"))
    n = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["ord"] < len(BASE))
    return out.select(F.col("id").alias(id_col), n("assign"), n("access"), n("hex"), F.sha2(_written(base), 256).alias("base_sha256"), _written(spans).alias("spans"))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``[kind]``; other rows and columns stay as they are.

    Spans that overlap are masked together, under the first one's kind.
    """
    name, h, spans = unused(docs, "id_"), unused(docs, "h_"), unused(docs, "spans_")
    found = find_spans(docs, id_col, text_col).select(F.col("id").alias(name), F.col("h").alias(h), F.col("spans").alias(spans))
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col(name)) & (F.xxhash64(text) == F.col(h)), "left")
    empty = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("upto"))
    step = lambda acc, s: F.when(
        s["start"] >= acc["upto"],
        F.struct(F.concat(acc["text"], F.substring(text, (acc["upto"] + 1).cast("int"), (s["start"] - acc["upto"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("text"), s["end"].alias("upto")),
    ).otherwise(F.struct(acc["text"].alias("text"), F.greatest(acc["upto"], s["end"]).alias("upto")))
    masked = F.aggregate(spans, empty, step, lambda acc: F.concat(acc["text"], F.substring(text, (acc["upto"] + 1).cast("int"), F.lit(2147483647))))
    return joined.select(*[F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(masked).alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns])

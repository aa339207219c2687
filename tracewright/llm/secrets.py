"""Secret scan by a trigram inverted index (DataFrame functions only).

Each rule's regex is turned into a Boolean query over lower-case trigrams that
every match must contain.  Postings ``(trigram, text key)`` are stored in the
order of their trigrams; a scan reads those of its rules, unites them per text and
evaluates each rule's query; only texts that satisfy it are verified with the regex.  A rule without mandatory
trigrams (``hex``) scans every text.

Defined results: a null text counts as empty and has no spans; an empty table
gives an empty result; repeated rows are each scanned and reported; all other
columns are ignored.  Texts share postings when their 64-bit keys agree, which
can only add candidates, never lose one, since each candidate is verified.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stage, unclaimed

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    import re._constants as sre
    import re._parser as parser


@dataclass(frozen=True)
class Rule:
    """``pattern`` is Java and RE2 syntax; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False


#: The three base rules, in the order that ties are listed.
BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What the scan adds: well-known public credential formats.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

# ---- regex -> Boolean trigram query --------------------------------------
# A query is True (no condition), a trigram, ("and", {...}) or ("or", {...}).
_CLASS, _EXACT = 12, 64  # larger classes and exact sets are treated as "any text"
_RUN = 256  # matches that gather in one array


def _join(op: str, parts):
    flat: set = set()
    for p in parts:
        if p is True:
            if op == "or":
                return True
            continue
        flat |= p[1] if isinstance(p, tuple) and p[0] == op else {p}
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _grams(s: str) -> object:
    """Trigrams that cover every character of ``s`` with the fewest lookups."""
    return _join("and", (s[i : i + 3] for i in sorted({*range(0, len(s) - 2, 3), len(s) - 3}) if i >= 0))


class _Info:
    """``exact``: all texts the node can match, or None; else ``pre``/``suf`` and ``query``."""

    def __init__(self, exact=None, pre=frozenset({""}), suf=frozenset({""}), query=True):
        self.exact, self.query = exact, query
        self.pre = frozenset(exact) if exact is not None else pre
        self.suf = frozenset(exact) if exact is not None else suf

    def whole(self):
        """The condition that this node puts on a text by itself."""
        if self.exact is not None:
            return _join("or", (_grams(s) for s in self.exact))
        return _join("and", [self.query, _join("or", map(_grams, self.pre)), _join("or", map(_grams, self.suf))])


def _concat(x: _Info, y: _Info) -> _Info:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= _EXACT:
        return _Info(frozenset(a + b for a in x.exact for b in y.exact))
    seam = True
    if len(x.suf) * len(y.pre) <= _EXACT:
        seam = _join("or", (_grams(a + b) for a in x.suf for b in y.pre))
    pre, suf = x.pre, y.suf
    if x.exact is not None and len(x.exact) * len(y.pre) <= _EXACT:
        pre = frozenset(a + b for a in x.exact for b in y.pre)
    if y.exact is not None and len(x.suf) * len(y.exact) <= _EXACT:
        suf = frozenset(a + b for a in x.suf for b in y.exact)
    return _Info(None, pre, suf, _join("and", [x.whole() if x.exact is None else _join("or", map(_grams, x.exact)), y.whole() if y.exact is None else _join("or", map(_grams, y.exact)), seam]))


def _either(parts: list[_Info]) -> _Info:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= _EXACT:
        return _Info(frozenset().union(*(p.exact for p in parts)))
    return _Info(query=_join("or", [p.whole() for p in parts]))


def _walk(nodes) -> _Info:
    out = _Info(frozenset({""}))
    for op, arg in nodes:
        if op is sre.LITERAL:
            got = _Info(frozenset({chr(arg).lower()}))
        elif op is sre.IN and arg[0][0] is not sre.NEGATE:
            chars: set | None = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < 64:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
                    break
            got = _Info(frozenset(chars)) if chars and len(chars) <= _CLASS else _Info()
        elif op is sre.SUBPATTERN:
            got = _walk(arg[3])
        elif op is sre.BRANCH:
            got = _either([_walk(x) for x in arg[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            one = _walk(body)
            if (low, high) == (0, 1):
                got = _either([_Info(frozenset({""})), one])
            elif low == 0:
                got = _Info()
            elif low == high and one.exact is not None and len(one.exact) == 1:
                got = _Info(frozenset({next(iter(one.exact)) * low}))
            else:
                got = _Info(None, one.pre, one.suf, one.whole())
        else:
            got = _Info()
        out = _concat(out, got)
    return out


def trigram_query(pattern: str):
    """Boolean query over lower-case trigrams that every match of ``pattern`` meets; True if none is mandatory."""
    return _walk(parser.parse(pattern)).whole()


def query_trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(query_trigrams, query[1]))


def _holds(query, has) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return has(query)
    parts = sorted(query[1], key=repr)
    out = _holds(parts[0], has)
    for p in parts[1:]:
        out = (out & _holds(p, has)) if query[0] == "and" else (out | _holds(p, has))
    return out


# ---- index, candidates, verification --------------------------------------


def postings(docs: DataFrame, key: str, text: str, grams: list[str]) -> DataFrame:
    """``(key, gram)``: which of ``grams`` (by position) stand in the lower-cased text.

    The text is lower-cased once, each gram sets a bit, and the set bits are listed.
    """
    low = docs.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("low"))
    word = lambda w: reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.contains("low", F.lit(g)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, g in enumerate(grams[63 * w : 63 * w + 63])])
    bits = low.select("key", *[word(w).alias(f"w{w}") for w in range(-(-len(grams) // 63))])
    found = F.array_compact(F.array(*[F.when(F.col(f"w{i // 63}").bitwiseAND(F.lit(1 << i % 63).cast("long")) != 0, F.lit(i)) for i in range(len(grams))]))
    return bits.select(F.col("key").alias(key), F.explode(found).alias("gram"))


def index(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Stored postings ``(gram, key)`` of the rules' trigrams, in the order of gram and text key; ``scan`` takes them for these or fewer rules."""
    grams = sorted(set().union(*(query_trigrams(trigram_query(r.pattern)) for r in rules)))
    body = F.coalesce(F.col(text), F.lit(""))
    posts = postings(docs.select(F.xxhash64(body).alias("key"), body.alias("text")), "key", "text", grams)
    at = F.element_at(F.array(*map(F.lit, grams)), F.col("gram") + 1) if grams else F.lit("")
    told = posts.select(at.alias("gram"), "key") if grams else docs.sparkSession.createDataFrame([], "gram string, key long")
    return stage(told.distinct().repartitionByRange("gram", "key").sortWithinPartitions("gram", "key"), "postings")


def candidates(posts: DataFrame, grams: list[str], queries: list) -> DataFrame:
    """Intersect and unite postings ``(gram, key)``: ``(key, mask)``, bit r set if rule r's query holds; queries that are True get no bit."""
    at = {g: i for i, g in enumerate(grams)}
    place = F.array_position(F.array(*map(F.lit, grams)), F.col("gram")).cast("int") - 1
    own = posts.where(F.col("gram").isin(grams)).select("key", place.alias("at"))
    words = [F.bit_or(F.when(F.floor(F.col("at") / 63) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 63).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range((len(grams) + 62) // 63)]
    has = lambda g: F.col(f"w{at[g] // 63}").bitwiseAND(F.lit(1 << (at[g] % 63)).cast("long")) != 0
    mask = reduce(lambda a, b: a + b, [F.when(_holds(q, has), F.lit(1 << r)).otherwise(F.lit(0)).cast("long") for r, q in enumerate(queries) if q is not True])
    return own.groupBy("key").agg(*words).select("key", mask.alias("mask")).where("mask <> 0")


def _run_of(rule: Rule) -> bool:
    """Whether the rule is one repeated class, so that its length can stand in the pattern."""
    return rule.group == 0 and re.fullmatch(r"\[[^]]*\]\+", rule.pattern) is not None


def _java(rule: Rule) -> str:
    return ("(?i)" if rule.fold else "") + (f"{rule.pattern[:-1]}{{{rule.least},}}" if _run_of(rule) else rule.pattern)


def _spans(text: Column, rule: Rule) -> Column:
    """Array of ``(start, end)`` of the rule's matches: gaps between matches give the offsets.

    Matches gather in runs of ``_RUN``, so that a text with very many of them is
    not copied once for each.
    """
    pat = F.lit(_java(rule))
    whole, part = F.regexp_extract_all(text, pat, F.lit(0)), F.regexp_extract_all(text, pat, F.lit(rule.group))
    lens = F.zip_with(F.transform(F.split(text, _java(rule), -1), F.char_length), F.zip_with(F.transform(whole, F.char_length), F.transform(part, F.char_length), lambda a, b: F.struct(a.alias("all"), b.alias("part"))), lambda g, m: F.struct(g.alias("gap"), m["all"].alias("all"), m["part"].alias("part")))
    few = "array<struct<s:int,e:int,n:int>>"
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(few).alias("now"), F.array().cast(f"array<{few}>").alias("done"))

    def step(acc, x):
        full = F.size(acc["now"]) >= _RUN
        one = F.struct((acc["pos"] + x["gap"]).alias("s"), (acc["pos"] + x["gap"] + x["all"]).alias("e"), x["part"].alias("n"))
        now = F.when(x["all"].isNull(), acc["now"]).when(full, F.array(one)).otherwise(F.array_append(acc["now"], one))
        done = F.when(x["all"].isNotNull() & full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"])
        return F.struct((acc["pos"] + x["gap"] + F.coalesce(x["all"], F.lit(0))).alias("pos"), now.alias("now"), done.alias("done"))

    found = F.aggregate(lens, start, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["now"]))
    return F.filter(found, lambda x: x["n"] >= rule.least)


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, into: str = "spans", posts: DataFrame | None = None) -> DataFrame:
    """``docs`` plus ``into``: array of ``(s, r, e)`` (start, rule number, end; code points), sorted by start, then rule.

    ``posts``: an :func:`index` of these texts made before, else one is made.  A
    column of ``docs`` that is already called ``into`` is an error.
    """
    unclaimed(docs, into)
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(query_trigrams, queries)))
    key = free_name(docs, "_key")
    mask = key + "m"
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    if not grams:
        joined = keyed.withColumn(mask, F.lit(0).cast("long"))
    else:
        found = stage(candidates(index(docs, text, rules) if posts is None else posts, grams, queries), "candidates")
        joined = keyed.join(found.select(F.col("key").alias(key), F.col("mask").alias(mask)), key, "left")
    body, parts = F.coalesce(F.col(text), F.lit("")), []
    for r, (rule, query) in enumerate(zip(rules, queries)):
        number = F.lit(r).alias("r")
        spans = F.transform(_spans(body, rule), lambda x: F.struct(x["s"].alias("s"), number, x["e"].alias("e")))  # noqa: B023
        if query is True:
            due = F.regexp_like(body, F.lit(_java(rule))) if _run_of(rule) else F.lit(True)
        else:
            due = F.coalesce(F.col(mask), F.lit(0)).bitwiseAND(F.lit(1 << r).cast("long")) != 0
        parts.append(F.when(due, spans).otherwise(F.array().cast("array<struct<s:int,r:int,e:int>>")))
    return joined.withColumn(into, F.array_sort(F.concat(*parts))).drop(key, mask)


def _listing(spans: Column, rules) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["r"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``docs(doc_id, text)``."""
    rules = BASE_RULES + MORE_RULES
    found = scan(docs.select("doc_id", "text"), "text", rules, "_found").drop("text")
    base = F.filter("_found", lambda x: x["r"] < len(BASE_RULES))
    count = lambda r: F.size(F.filter("_found", lambda x: x["r"] == r)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listing(base, rules).cast("binary"), 256).alias("base_sha256"), _listing(F.col("_found"), rules).alias("spans"),
    )


def _sql_spans(rule: Rule, number: int) -> str:
    pat = rule.pattern.replace("'", "''")
    if rule.fold:
        pat = re.sub(r"[a-z](?![^(]*\])", lambda m: f"[{m[0].upper()}{m[0]}]", pat.split(")", 1)[0]) + ")" + pat.split(")", 1)[1]
    cut = f"list_transform(string_split_regex(t, '{pat}'), lambda x: length(x))"
    whole, part = (f"list_transform(regexp_extract_all(t, '{pat}', {g}), lambda x: length(x))" for g in (0, rule.group))
    return f"""SELECT u, {number} AS r, '{rule.kind}' AS kind, s, s + w AS e FROM (
      SELECT u, unnest(list_transform(range(1, len(ws) + 1), lambda i: list_sum(gs[1:i]) + coalesce(list_sum(ws[1:i-1]), 0)))::BIGINT AS s,
             unnest(ws) AS w, unnest(ps) AS p
      FROM (SELECT u, {cut} AS gs, {whole} AS ws, {part} AS ps FROM d)) WHERE p >= {rule.least}"""


def oracle() -> str:
    """The same result by full scans, in DuckDB SQL."""
    rules = BASE_RULES + MORE_RULES
    union = "\n  UNION ALL ".join(_sql_spans(r, i) for i, r in enumerate(rules))
    say = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r)"
    return f"""WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({union}),
g AS (SELECT u, count(*) FILTER (r = 0) AS a, count(*) FILTER (r = 1) AS b, count(*) FILTER (r = 2) AS c,
  {say} FILTER (r < {len(BASE_RULES)}) AS base, {say} AS spans FROM f GROUP BY u)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (u)"""

"""Secret scans through a trigram inverted index.

Each rule's regular expression yields a Boolean query over the trigrams that any match must hold.
Postings of just those trigrams are built per block of documents, intersected and united
as the queries say, and only the candidates are scanned. A rule without mandatory trigrams
(a bare class of characters) scans every text. The index is of lower-cased texts; the
verification decides about case.

Defined results: null and empty texts have no spans; repeated rows each get their spans; an empty
table gives an empty result; further columns are not read. Texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm import spans as S
from lakeweave.llm.common import exploded, identified, within

# Documents per block of the index; a posting list has this many entries on average at most.
BLOCK_ROWS = 256
# Strings that the analysis of an expression keeps side by side before it gives up on a part.
MAX_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    """``keep`` says of a match (field ``v`` is its text) whether it counts.

    ``plain`` is the pattern for engines without possessive repeats and look-aheads, if ``pattern`` has some: its groups
    together are the match, what it takes beyond them is only looked at.
    """

    kind: str
    pattern: str
    keep: Callable[[Column], Column] | None = None
    base: bool = False
    plain: str | None = None


# The three base kinds, in the order in which spans are listed.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
)
ASSIGN_HEAD = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?"
BASE_RULES = (
    # The value alone must have six characters; a shorter one still uses up its text.
    Rule("assign", ASSIGN, lambda x: F.length(F.regexp_replace(x["v"], ASSIGN_HEAD, "")) >= 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda x: F.length(x["v"]) >= 20, True),
    # Shorter runs are dropped anyway and hide no longer one, so the bound may stand in the expression.
    Rule("hex", r"[0-9a-f]{24,}", base=True),
)
# A private key goes to its END line, or else over its header lines and its lines of base64; line ends may be
# written as \n and lines may be quoted. Possessive repeats keep the engine from retrying and from recursion.
_BREAK = r"(?:\\[nr]|[\r\n])(?:\\[nrt]|[\x20\x09\r\n\"',>|*#])*+"
# The first part of a header's name is shorter than any line of base64, so a line is one or the other.
_NAME = r"[A-Z][A-Za-z0-9]{0,18}+(?:-[A-Za-z0-9]*+)*+"
PEM = (
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:"
    r"[^-]*+(?:-(?!----)[^-]*+)*+-{5,}+END [A-Z ]{0,24}PRIVATE KEY-----"
    rf"|(?:{_BREAK}{_NAME}:\x20[^\r\n\\]*+)*+"
    r"(?:(?:(?:\\[nrt]|[\x20\x09\r\n\"',>|*#])*+[A-Za-z0-9+/]{20,}+=*+)++"
    rf"(?:{_BREAK}[A-Za-z0-9+/]++=*+(?=[\x20\x09\"',]*+(?:[\r\n\\]|$)))?+)?+)"
)
# The same without possessive repeats: a key with its END line, one with base64, one with header lines only.
_PLAIN_BREAK = _BREAK.replace("*+", "*")
_BEGIN = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
_HEADER = rf"(?:{_PLAIN_BREAK}{_NAME.replace('}+', '}').replace('*+', '*')}:\x20[^\r\n\\]*)"
_SEPARATOR = r"(?:\\[nrt]|[\x20\x09\r\n\"',>|*#])*"
_BASE64 = rf"[A-Za-z0-9+/]{{20,}}=*(?:{_SEPARATOR}[A-Za-z0-9+/]{{20,}}=*)*"
PLAIN_PEM = (
    rf"({_BEGIN}[^-]*(?:-{{1,4}}[^-]+)*-{{5,}}END [A-Z ]{{0,24}}PRIVATE KEY-----)"
    # A line of headers goes to its end, so what follows the last one begins with a line end.
    rf"|({_BEGIN}(?:{_HEADER}+(?:\\[nrt]|[\r\n]))?{_SEPARATOR}{_BASE64})"
    rf"(?:({_PLAIN_BREAK}[A-Za-z0-9+/]+=*)[\x20\x09\"',]*(?:[\r\n\\]|$))?"
    rf"|({_BEGIN}{_HEADER}*)"
)
LOGIN_URL = r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D:/@]++:[^\x20\x09-\x0D/@]++@"
# Published formats of tokens and keys.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", PEM, plain=PLAIN_PEM),
    Rule("login_url", LOGIN_URL, plain=f"({LOGIN_URL.replace('++', '+')})"),
    Rule("bearer", r"[Bb]earer\x20{1,4}[A-Za-z0-9._~+/-]{20,}"),
)
RULES = BASE_RULES + MORE_RULES


# -- Boolean trigram queries ------------------------------------------------------------------

Query = tuple[tuple[frozenset[str], ...], ...]  # all of (any of (all of these trigrams))


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _class_letters(items) -> set[str] | None:
    """The few lower-cased letters of a class, or None if it is large or negated."""
    out: set[str] = set()
    for op, value in items:
        if op is K.LITERAL:
            out.add(chr(value).lower())
        elif op is K.RANGE and value[1] - value[0] < 6:
            out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
        if len(out) > 6:
            return None
    return out


def _exact(nodes) -> set[str] | None:
    """All strings that a part can match, or None if they are many."""
    have = {""}
    for op, value in nodes:
        if op is K.LITERAL:
            more = {chr(value).lower()}
        elif op is K.IN:
            more = _class_letters(value)
        elif op is K.SUBPATTERN:
            more = _exact(value[3])
        elif op is K.BRANCH:
            parts = [_exact(b) for b in value[1]]
            more = None if None in parts else set().union(*parts)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[1] <= 1:
            part = _exact(value[2])
            more = None if part is None else part | ({""} if value[0] == 0 else set())
        else:
            more = None
        if more is None or len(more) * len(have) > MAX_STRINGS:
            return None
        have = {a + b for a in have for b in more}
    return have


def trigram_query(pattern: str) -> Query:
    """What the trigrams of a lower-cased text must fulfil if the pattern matches in it.

    A conjunction of groups; a group is a disjunction of sets of trigrams that must all occur.
    No group at all: the pattern has no mandatory trigrams.
    """
    groups: list[tuple[frozenset[str], ...]] = []

    def flush(have: set[str]) -> None:
        if all(len(s) >= 3 for s in have):
            sets = {_grams(s) for s in have}
            # A set that holds another one is fulfilled only where that one is.
            groups.append(tuple(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted)))

    def walk(nodes) -> None:
        have = {""}
        for node in nodes:
            op, value = node
            more = _exact([node])
            if more is not None and len(more) * len(have) <= MAX_STRINGS:
                have = {a + b for a in have for b in more}
                continue
            flush(have)
            have = {""}
            if more is not None:
                have = more
            elif op is K.SUBPATTERN:
                walk(value[3])
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] >= 1:
                walk(value[2])
        flush(have)

    walk(_parser.parse(pattern))
    return tuple(groups)


# -- the index --------------------------------------------------------------------------------


def wanted_trigrams(rules) -> list[str]:
    return sorted({t for r in rules for group in trigram_query(r.pattern) for grams in group for t in grams})


def postings(texts: DataFrame, trigrams: list[str], blocks: int) -> DataFrame:
    """``block, index``: a map from trigram to the keys of the block's texts that hold it.

    ``texts`` has ``rk`` and ``text``. Only trigrams that some query asks for are indexed.
    """
    low = texts.select("rk", F.lower("text").alias("low"))
    hits = low.select(
        "rk", F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])).alias("ts")
    )
    lists = (
        exploded(hits.select("*", F.pmod("rk", F.lit(blocks)).alias("block")), ["block", "rk"], "ts", "t")
        .repartition("block")
        .groupBy("block", "t")
        .agg(F.collect_set("rk").alias("keys"))
    )
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("t", "keys"))).alias("index"))


def _evaluate(query: Query) -> Column:
    """The keys that fulfil a query, by intersecting and uniting posting lists."""

    def all_of(grams: frozenset[str]) -> Column:
        out = None
        for t in sorted(grams):
            keys = F.coalesce(F.col("index")[t], F.expr("cast(array() AS array<bigint>)"))
            out = keys if out is None else F.array_intersect(out, keys)
        return out

    out = None
    for group in query:
        any_of = None
        for grams in group:
            keys = all_of(grams)
            any_of = keys if any_of is None else F.array_union(any_of, keys)
        out = any_of if out is None else F.array_intersect(out, any_of)
    return out


def candidates(texts: DataFrame, rules, blocks: int) -> DataFrame:
    """``rk, kinds``: which indexed rules may match in which text."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    index = postings(texts, wanted_trigrams(rules), blocks)

    def found(kind: str) -> Column:
        return F.transform(_evaluate(queries[kind]), lambda k: F.struct(k.alias("rk"), F.lit(kind).alias("kind")))

    lists = index.select("block", F.flatten(F.array(*[found(kind) for kind in queries])).alias("xs"))
    pairs = exploded(lists, ["block"], "xs", "x")
    return pairs.groupBy("block", F.col("x.rk").alias("rk")).agg(F.collect_set("x.kind").alias("kinds")).drop("block")


def scan(documents: DataFrame, rules=RULES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, text, row, base, spans`` per row of ``documents``.

    ``row`` holds the columns other than the text; spans are structs of start ``s``, place of the kind
    ``k``, end ``e`` and ``kind``, in this order.
    """
    texts = identified(documents, rest=True)
    indexed = [r for r in rules if trigram_query(r.pattern)]
    if indexed:
        blocks = max(1, -(-texts.count() // block_rows))
        joined = texts.join(within(candidates(texts, indexed, blocks)), "rk", "left")
    else:
        joined = texts.withColumn("kinds", F.expr("cast(null AS array<string>)"))
    cuts, columns = [], []
    for i, r in enumerate(rules):
        cut = S.cut(F.col("text"), r.pattern)
        cuts.append((F.when(F.array_contains("kinds", r.kind), cut) if r in indexed else cut).alias(f"c_{r.kind}"))
        found = S.places(f"c_{r.kind}")
        columns.append(S.labelled(found if r.keep is None else F.filter(found, r.keep), i, r.kind).alias(f"f_{r.kind}"))
    each = joined.select("doc_id", "text", "row", *cuts).select("doc_id", "text", "row", *columns)
    return each.select(
        "doc_id",
        "text",
        "row",
        F.array_sort(F.flatten(F.array(*[F.col(f"f_{r.kind}") for r in rules if r.base]))).alias("base"),
        F.array_sort(F.flatten(F.array(*[F.col(f"f_{r.kind}") for r in rules]))).alias("spans"),
    )


def redact(documents: DataFrame, rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``; a column ``n_chars`` follows the text.

    Overlapping spans become one mark. Rows without spans stay as they are, null texts too.
    """
    found = scan(documents, rules).select("text", "row", "spans")
    out = found.select("row", F.size("spans").alias("hits"), S.replaced("text", "spans", mark).alias("text"))
    return S.rebuilt(out, documents)

"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select.

Strict generators give the base spans (e-mail and IP addresses, card and phone numbers) and
their failing look-alikes; loose ones add written-out addresses, IPv6 and numbers in
other layouts, overlapping the strict ones as they like. Binned features of the words and characters
around a candidate are counted over all documents; the trees learn from one half of the candidates
which stand like validated data, without seeing how they are written. What is no base span has a
weak label that every way of writing can earn or miss (known top-level domain, IPv6 groups, check
digit, dialling layout), and a threshold per kind and way of writing, set by the labels of such
candidates alone, so it depends neither on how many base spans there are nor on other ways of
writing. Spans above it join the base spans.

Candidates are written once, without texts, so the texts are scanned once and nothing is shuffled but
the counts of feature cells, whose number the bins bound.

Defined results: null and empty texts have no spans; repeated rows each get theirs; an empty table
gives an empty result; further columns are not read. Texts of any length are scanned whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm import boosting
from lakeweave.llm import spans as S
from lakeweave.llm.common import identified
from lakeweave.session import materialize

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95

# Strict generators. Possessive repeats and the look-behind only spare the engine useless retries: a
# match can begin nowhere else than at the start of a run or where the match before it ended.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?(?:@|\(at\)|\[at\])\x20?|\x20{1,2}at\x20{1,2})"
# A full stop and a blank end a sentence, unless such a domain follows.
_DOT = (
    r"(?:\.|\x20\.\x20|(?:\x20\.|\.\x20)(?=(?:com|org|net|edu|gov)(?![A-Za-z0-9-]))"
    r"|\x20?(?:\(dot\)|\[dot\])\x20?|\x20{1,2}dot\x20{1,2})"
)
LOOSE = {
    "email": (
        rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}"
        rf"(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}"
    ),
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "number": r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9])",
}
# Words that announce a kind of data, and words that announce other numbers.
CUES = (
    r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|tél|teléfono)\b",
    r"(?i)\b(?:card|visa|mastercard|credit|debit|pay|karte|carte|tarjeta)\b",
    r"(?i)\b(?:ip|server|host|address|ping|login|adresse)\b",
    r"(?i)(?:\b(?:version|order|id|no|nr|number|price|total|isbn|page|ref|invoice)\b|[$€£#])",
)
# Top-level domains: the common ones and those of countries.
TLD = (
    "com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|xyz|online|site|store|tech|cloud|example|test|"
    "ac|ad|ae|af|ag|ai|al|am|ao|aq|ar|as|at|au|aw|ax|az|ba|bb|bd|be|bf|bg|bh|bi|bj|bm|bn|bo|br|bs|bt|bw|by|bz|ca|cc|cd|cf|cg|ch|"
    "ci|ck|cl|cm|cn|co|cr|cu|cv|cw|cx|cy|cz|de|dj|dk|dm|do|dz|ec|ee|eg|er|es|et|eu|fi|fj|fk|fm|fo|fr|ga|gd|ge|gf|gg|gh|gi|gl|gm|"
    "gn|gp|gq|gr|gs|gt|gu|gw|gy|hk|hm|hn|hr|ht|hu|id|ie|il|im|in|io|iq|ir|is|it|je|jm|jo|jp|ke|kg|kh|ki|km|kn|kp|kr|kw|ky|kz|la|"
    "lb|lc|li|lk|lr|ls|lt|lu|lv|ly|ma|mc|md|me|mg|mh|mk|ml|mm|mn|mo|mp|mq|mr|ms|mt|mu|mv|mw|mx|my|mz|na|nc|ne|nf|ng|ni|nl|no|np|"
    "nr|nu|nz|om|pa|pe|pf|pg|ph|pk|pl|pm|pn|pr|ps|pt|pw|py|qa|re|ro|rs|ru|rw|sa|sb|sc|sd|se|sg|sh|si|sk|sl|sm|sn|so|sr|ss|st|su|"
    "sv|sx|sy|sz|tc|td|tf|tg|th|tj|tk|tl|tm|tn|to|tr|tt|tv|tw|tz|ua|ug|uk|us|uy|uz|va|vc|ve|vg|vi|vn|vu|wf|ws|ye|yt|za|zm|zw"
)
# Lengths and first digits of card issuers.
ISSUED = r"^(?:4(?:.{12}|.{15}|.{18})|(?:5[1-5]|2[2-7]).{14}|3[47].{13}|3[0689].{12}|35.{14}|6.{15,18})$"
AREA = r"^\((?:0[1-9][0-9]{0,3}\)[0-9\x20.-]{6,14}|[2-9][0-9]{2}\)[\x20.-]{0,2}[0-9]{3}[\x20.-]?[0-9]{4})$"
GROUPED = r"^(?:1[\x20.-])?[2-9][0-9]{2}[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}$"
# None of them tells how a span is written, as that tells which generator proposed it.
FEATURES = ("kind", "cue", "left", "right")
# Ways of writing per kind at most; number 0 is that of the strict generators.
FORMS = 5
_TYPE = "array<struct<k: int, s: int, e: int, kind: string, base: boolean, form: int, weak: boolean, f: array<int>>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(doubled, c.cast("int"))),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    """The checks of the base spans."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return v.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(_digits(v))
    return n.between(16, 19) & luhn(_digits(v)) if kind == "card" else n.between(8, 15)


def _beside(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^[\x20\x09-\x0D]$"), 1).when(c.rlike("^[A-Za-z0-9]$"), 3).otherwise(2)


def written(kind: Column, v: Column) -> tuple[Column, Column]:
    """How a loose span is written, 1 or more, and its weak label.

    Bare digits and a written-out "at" before a plain domain have no label to earn, as dates and prose
    look the same.
    """
    digits = _digits(v)
    n = F.length(digits)
    spelled = ~v.rlike(r"@|[(\[]at[)\]]")
    email = F.when(v.contains("@"), 1).when(~spelled, 2).when(~v.rlike(r"\x20at\x20[^.]*\."), 3).otherwise(4)
    # Groups of two digits each are the address of a device.
    device = v.rlike("^(?:[0-9A-Fa-f]{2}:){7}[0-9A-Fa-f]{2}$")
    phone = F.when(v.rlike(r"^\(?(?:\+|00)"), 1).when(v.startswith("("), 2).when(n < F.length(v), 3).otherwise(4)
    form = F.when(kind == 0, email).when(kind == 1, F.when(device, 2).otherwise(1))
    form = form.when(kind == 2, F.when(digits.rlike(ISSUED), 1).otherwise(2)).otherwise(phone)
    dialled = F.when(phone == 1, v.rlike(r"^\(?(?:\+|00)\(?[1-9]") & n.between(8, 15)).when(phone == 2, v.rlike(AREA))
    known = v.rlike(rf"(?i)[^A-Za-z0-9-](?:{TLD})$") & (email != 4)
    weak = F.when(kind == 0, known).when(kind == 1, ~device).when(kind == 2, n.between(13, 19) & luhn(digits))
    return form, weak.otherwise(dialled.when(phone == 3, v.rlike(GROUPED)).otherwise(False))


def _features(kind: Column, x: Column) -> Column:
    cue = F.lit(0)
    for i, words in reversed(list(enumerate(CUES, 1))):
        cue = F.when(x["b"].rlike(words), i).otherwise(cue)
    return F.array(kind, cue, _beside(F.right(x["b"], F.lit(1))), _beside(F.left(x["a"], F.lit(1))))


def _proposed(column: str, kind: str | None, strict: bool) -> Column:
    def one(x):
        if kind is None:
            k = F.when(F.length(_digits(x["v"])) >= 13, 2).otherwise(3)
        else:
            k = F.lit(KINDS.index(kind))
        base = valid(kind, x["v"]) if strict else F.lit(False)
        # What the validation of the strict generators rejects is wrong, so it earns no label.
        form, weak = (F.lit(0), F.lit(False)) if strict else written(k, x["v"])
        name = F.element_at(F.array(*[F.lit(n) for n in KINDS]), k + 1)
        return F.struct(
            k.alias("k"), x["s"].alias("s"), x["e"].alias("e"), name.alias("kind"), base.alias("base"),
            form.alias("form"), weak.alias("weak"), _features(k, x).alias("f"),
        )

    return F.transform(S.places(column), one)


def candidates(documents: DataFrame, rest: bool = False) -> DataFrame:
    """``doc_id, found`` per row: all proposed spans with kind, ``base``, way of writing, weak label and feature bins."""
    texts = identified(documents, rest=rest)
    kept = ["doc_id", *(["text", "row"] if rest else [])]
    text = F.col("text")
    number = text.rlike("[0-9]")
    at = text.contains("@")
    dot = text.contains(" dot ") | text.contains("(dot)") | text.contains("[dot]")
    spelled = at | text.contains("(at)") | text.contains("[at]") | (text.contains(" at ") & dot)
    gates = {"email": at, "ip": number, "card": number, "phone": text.contains("+") & number}
    loose_gates = {"email": spelled, "ip": text.contains(":"), "number": number}
    cuts = [F.when(gates[k], S.cut(text, p)).alias(f"s_{k}") for k, p in STRICT.items()]
    cuts += [F.when(loose_gates[k], S.cut(text, p)).alias(f"l_{k}") for k, p in LOOSE.items()]
    parts = [_proposed(f"s_{k}", k, True) for k in STRICT]
    parts += [_proposed(f"l_{k}", None if k == "number" else k, False) for k in LOOSE]
    every = texts.select(*kept, *cuts).select(*kept, F.flatten(F.array(*parts)).cast(_TYPE).alias("found"))
    # A loose span that equals a base one is that one.
    base = F.filter("found", lambda x: x["base"])
    return every.select(*kept, "found", F.transform(base, lambda x: F.struct(x["k"], x["s"], x["e"])).alias("known")).select(
        *kept,
        F.expr(
            "filter(found, x -> x.base OR NOT exists(known, y -> y.k = x.k AND y.s = x.s AND y.e = x.e) OR size(known) < 0)"
        ).alias("found"),
    )


def fit(found: DataFrame, precision: float = PRECISION) -> tuple[boosting.Model, list[float]]:
    """Trees and thresholds from the counts of feature cells over all candidates.

    The threshold of kind ``k`` in way of writing ``form`` is number ``form * len(KINDS) + k``. The weak labels
    are unknown to the trees, so those of both halves count. Where no candidate is open, held-out base ones decide.
    """
    one = found.select("doc_id", F.explode("found").alias("x")).select(
        "x.f", "x.form", "x.base", "x.weak", F.pmod(F.xxhash64("doc_id", "x.s"), F.lit(2)).alias("half")
    )
    counts = (
        one.groupBy("f", "form")
        .agg(
            F.count_if(F.col("half") == 0).alias("n0"),
            F.count_if((F.col("half") == 0) & F.col("base")).alias("y0"),
            F.count_if(F.col("half") == 1).alias("n1"),
            F.count_if((F.col("half") == 1) & F.col("base")).alias("y1"),
            F.count_if(~F.col("base")).alias("n2"),
            F.count_if(~F.col("base") & F.col("weak")).alias("y2"),
        )
        .orderBy("f", "form")
        .collect()
    )
    cells = np.array([r["f"] for r in counts], dtype=int).reshape(len(counts), len(FEATURES))
    forms = np.array([r["form"] for r in counts], dtype=int)
    n0, y0, n1, y1, n2, y2 = (np.array([r[c] for r in counts], dtype=float) for c in ("n0", "y0", "n1", "y1", "n2", "y2"))
    model = boosting.fit(cells, n0, y0)
    margin = model.margin(cells)
    limits = []
    for form in range(FORMS):
        for k in range(len(KINDS)):
            kind = cells[:, 0] == k
            of = kind & (forms == form) & (n2 > 0)
            n, y = (n2, y2) if of.any() else (n1, y1)
            of = of if of.any() else kind & (n1 > 0)
            limits.append(boosting.threshold(margin[of], n[of], y[of], precision))
    return model, limits


def scan(documents: DataFrame, precision: float = PRECISION, rest: bool = False) -> DataFrame:
    """``doc_id, base, spans`` per row (with ``rest`` also ``text, row``), ordered by kind and start."""
    found = materialize(candidates(documents, rest), "pii")
    model, limits = fit(found, precision)
    margin = model.sql([f"x.f[{i}]" for i in range(len(FEATURES))])
    limit = " ".join(f"WHEN {i} THEN {t - 1e-9!r}D" for i, t in enumerate(limits) if t < float("inf"))
    above = f"{margin} >= CASE x.form * {len(KINDS)} + x.k {limit} ELSE double('Infinity') END" if limit else "false"
    place = "x -> struct(x.k AS k, x.s AS s, x.e AS e, x.kind AS kind)"
    return found.select(
        "doc_id",
        *(["text", "row"] if rest else []),
        F.expr(f"array_sort(transform(filter(found, x -> x.base), {place}))").alias("base"),
        F.expr(f"array_sort(array_distinct(transform(filter(found, x -> x.base OR {above}), {place})))").alias("spans"),
    )


def redact(documents: DataFrame, mark: str = "[PII]") -> DataFrame:
    """The documents with every selected span replaced by ``mark``; rows without spans stay as they are."""
    found = scan(documents, rest=True)
    ordered = found.select(
        "text", "row", F.expr("array_sort(transform(spans, x -> struct(x.s AS s, x.e AS e)))").alias("spans")
    )
    out = ordered.select("row", F.size("spans").alias("hits"), S.replaced("text", "spans", mark).alias("text"))
    return S.rebuilt(out, documents)

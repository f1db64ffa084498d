"""Operator 8: personal data by patterns, checksums and context words.

All native: regular expressions propose spans, validators (value ranges, Luhn,
mod-97, digit counts) confirm them, and words close to a span move its score.
One map-only pass; no Python, no shuffle.

Spans are found with ``regexp_extract_all`` for the matches and ``split`` on
the same pattern for what lies between; the running sum of their lengths gives
every match its place in code points. Folds are made in groups of a fixed size
(``_running``), so time is linear in the matches. The patterns are written so
that the matcher never backtracks over a run of characters (possessive repeats,
and a look-behind that starts a match only where a run starts), so time is
linear in the text too.

Base kinds (email, ip, card, phone) are kept once validated, whatever their
score. The kinds that the method adds (iban, ssn, secret) need a score of
``MIN_SCORE``: iban by mod-97 alone, the other two only with a context word.

Defined results: null text counts as empty and has no spans, whose digest is
that of the empty string; a null doc_id keeps its row; repeated rows stay
repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.storage import table

MIN_SCORE = 50
#: Code points before and after a span in which context words count.
BEFORE, AFTER = 48, 24
#: Values that are folded at once, and levels of such groups.
GROUP, LEVELS = 32, 4
#: Code points of a piece of a text that is redacted.
CHUNK = 1024


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: int  # of a validated span, in hundredths
    context: str  # words that add BONUS
    base: bool = True


BONUS = 30
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 70,
         r"(?i)\b(e-?mail|mail|contact|kontakt|correo|courriel)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 60, r"(?i)\b(ip|host|server|address|adresse|login)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", 65, r"(?i)\b(card|visa|credit|payment|karte|carte|tarjeta)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 65, r"(?i)\b(phone|tel|call|mobile|telefon|fax)\b"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", 60, r"(?i)\b(iban|account|konto|compte|cuenta|bank)\b", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 30, r"(?i)\b(ssn|social security)\b", False),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}+(?![A-Za-z0-9])", 30, r"(?i)\b(token|secret|password|api[ _-]?key)\b", False),
)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(
            F.split(m, r"\.", -1), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255)
        )
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        plain = F.regexp_replace(m, " ", "")
        turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
        step = lambda r, c: F.when(
            c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97
        ).otherwise((r * 100 + F.ascii(c) - 55) % 97)
        return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step) == 1)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, start: Column, step: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """For each of ``values`` the fold of ``start`` and all values before it.

    ``step`` is associative. Values are folded in groups of ``GROUP``, whose own
    folds are made likewise, so an array of n is copied about GROUP / 2 * n
    times instead of n * n / 2 (for up to GROUP ** (levels + 1) values).
    """

    def short(part: Column, first: Column) -> Column:
        none = F.array().cast("array<int>")
        grown = F.aggregate(
            part, F.struct(first.alias("now"), none.alias("out")),
            lambda acc, x: F.struct(step(acc["now"], x).alias("now"), F.array_append(acc["out"], acc["now"]).alias("out")),
        )
        return grown["out"]

    if not levels:
        return short(values, start)

    def grouped(all_: Column) -> Column:
        part = lambda i: F.slice(all_, i * GROUP + 1, F.lit(GROUP))
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / GROUP).cast("int")), lambda i: F.aggregate(part(i), F.lit(0), step))
        return _let(_running(sums, start, step, levels - 1), lambda before: F.flatten(F.transform(before, lambda first, i: short(part(i), first))))

    return F.when(F.size(values) <= GROUP, short(values, start)).otherwise(_let(values, grouped))


def _spans(text: Column, kind: Kind) -> Column:
    """Array of (kind, start, end, score) of the kept spans of one kind."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:int>>")

    def placed(found: Column, gaps: Column) -> Column:
        each = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        return _let(_running(each, F.lit(0), lambda x, y: x + y), lambda at: F.transform(found, lambda m, i: span(m, F.get(at, i), F.get(gaps, i), F.get(gaps, i + 1))))

    def span(m: Column, at: Column, gap: Column, after: Column) -> Column:
        near = F.right(gap, F.lit(BEFORE)).rlike(kind.context) | F.left(after, F.lit(AFTER)).rlike(kind.context)
        start = at + F.length(gap)
        score = F.lit(kind.score) + F.when(near, BONUS).otherwise(0)
        made = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), score.alias("score"))
        return F.when(_valid(kind.name, m) & (score >= (0 if kind.base else MIN_SCORE)), made)

    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    kept = lambda m: F.filter(_let(F.split(text, kind.pattern, -1), lambda gaps: placed(m, gaps)), lambda s: s.isNotNull())
    return _let(found, lambda m: F.when(F.size(m) > 0, kept(m)).otherwise(none))


def with_spans(docs: DataFrame, text: str = "text", prefix: str = "pii_") -> DataFrame:
    """docs with an array of spans for each kind, in columns ``prefix`` + kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({prefix + k.name: _spans(whole, k) for k in KINDS})


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans, scores."""
    found = with_spans(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    base = [F.col(f"pii_{k.name}") for k in KINDS if k.base]
    every = F.concat(*(F.col(f"pii_{k.name}") for k in KINDS))
    count = lambda k: F.size(f"pii_{k}").cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k.name) for k in KINDS if k.base), F.sha2(_joined(F.concat(*base)), 256).alias("base_sha256"),
        _joined(every).alias("spans"), F.array_join(F.transform(every, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of the spans (sorted by start) replaced, but for those that begin within one before.

    The text is cut into chunks once, since a substring is looked for from the start of its string.
    """

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), a - first * CHUNK + 1, b - a)

    def filled(chunks: Column, ends: Column) -> Column:
        def put(s: Column, i: Column) -> Column:
            label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.when(s["start"] >= F.get(ends, i), F.concat(piece(chunks, F.get(ends, i), s["start"]), label)).otherwise("")

        end = F.greatest(F.element_at(ends, -1), F.element_at(spans, -1)["end"])
        return F.concat(F.array_join(F.transform(spans, put), ""), piece(chunks, end, F.length(text)))

    return _let(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)),
        lambda chunks: _let(
            _running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda x, y: F.greatest(x, y)), lambda ends: filled(chunks, ends)
        ),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs, every span of ``text`` replaced by its kind in brackets; null stays null.

    A column n_chars is kept equal to the new length.
    """
    placed = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    spans = F.array_sort(F.flatten(F.array(*(F.transform(F.col(f"pii_{k.name}"), placed) for k in KINDS))))
    # the whole table under names that clash with none of the spans'
    plain = [f"_{i}" if c != "text" else c for i, c in enumerate(docs.columns)]
    text = _let(spans, lambda s: F.when(F.size(s) > 0, _replaced(F.col("text"), s)).otherwise(F.col("text")))
    done = with_spans(docs.toDF(*plain)).select(*(text.alias("text") if c == "text" else F.col(c) for c in plain)).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))

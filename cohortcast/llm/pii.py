"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Everything is one projection over the text: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortcast.llm.common import let, mod_sums

CONTEXT_CHARS = 40
CONTEXT_POINTS = 20


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``points`` of 100 go to a match that passes ``confirm``, ``CONTEXT_POINTS`` more to one near a
    word of ``context``. Base kinds are kept whatever their score.
    """

    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    points: int
    context: str
    hint: str
    base: bool = True


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _ip(hit: Column) -> Column:
    part = "0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    return hit.rlike(rf"^{part}(\.{part}){{3}}$")


def _card(hit: Column) -> Column:
    return let(_digits(hit), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d))


def _iban(hit: Column) -> Column:
    """Length of 15 to 34 and, with the first four characters last, a remainder of 1 by 97."""

    def remainder(code: Column) -> Column:
        turned = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
        return F.aggregate(
            F.split(turned, ""), F.lit(0),
            lambda rest, c: F.when(
                F.ascii(c) >= 65, (rest * 100 + F.ascii(c) - 55) % 97
            ).otherwise((rest * 10 + F.ascii(c) - 48) % 97),
        )

    return let(
        F.replace(hit, F.lit(" "), F.lit("")),
        lambda code: F.length(code).between(15, 34) & (remainder(code) == 1),
    )


#: Leftmost matches as the plain patterns give them. Possessive repeats and the "not inside a run"
#: starts only keep the search linear in the text.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda hit: F.lit(True), 80, r"(?i)mail|contact|write to", "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
         _ip, 60, r"(?i)\bip\b|address|host|server", "."),
    Kind("card", r"[0-9](?:[ -]?[0-9])++",
         _card, 80, r"(?i)card|visa|master|credit|pay", ""),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]",
         lambda hit: F.length(_digits(hit)).between(10, 15), 60, r"(?i)phone|tel|call|mobile", "+"),
    Kind("iban", r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]){11,30}",
         _iban, 80, r"(?i)iban|account|bank", "", base=False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         lambda hit: ~hit.rlike("^(000|666|9)|-00-|-0000$"), 40, r"(?i)\bssn\b|social security", "-",
         base=False),
)
MIN_POINTS = 60


def _spans_of(kind: Kind, rank: int, text: Column, min_points: int) -> Column:
    """Confirmed spans of one kind: array of (start, rank, stop, kind, points)."""

    def build(found: Column) -> Column:
        gaps, hits = found["gaps"], found["hits"]
        gap_sizes = F.transform(gaps, lambda g: F.length(g).cast("long"))
        sizes = F.zip_with(
            gap_sizes, F.transform(hits, lambda h: F.length(h).cast("long")),
            lambda gap, hit: gap + F.coalesce(hit, F.lit(0).cast("long")),
        )

        def rows(parts: Column) -> Column:
            def row(hit: Column, i: Column) -> Column:
                start = parts["before"][i] + parts["gap"][i]
                near = F.concat_ws(
                    " ", F.right(gaps[i], F.lit(CONTEXT_CHARS)),
                    F.left(gaps[i + 1], F.lit(CONTEXT_CHARS)),
                )
                points = F.lit(kind.points) + F.when(
                    near.rlike(kind.context), CONTEXT_POINTS
                ).otherwise(0)
                return F.struct(
                    start.alias("start"), F.lit(rank).alias("rank"),
                    (start + F.length(hit)).alias("stop"), F.lit(kind.name).alias("kind"),
                    F.when(F.coalesce(kind.confirm(hit), F.lit(False)), points).otherwise(0).alias("points"),
                )

            return F.transform(hits, row)

        return let(F.struct(mod_sums(sizes).alias("before"), gap_sizes.alias("gap")), rows)

    none = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string,points:int>>")
    found = F.struct(
        F.split(text, kind.pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"),
    )
    least = 1 if kind.base else min_points
    spans = F.filter(let(found, build), lambda s: s["points"] >= least)
    return F.when(F.contains(text, F.lit(kind.hint)) & text.rlike(kind.pattern), spans).otherwise(none)


def find_pii(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    kinds: tuple[Kind, ...] = KINDS,
    min_points: int = MIN_POINTS,
) -> DataFrame:
    """Personal data in whole texts: one row (id, ``pii``) per input row.

    ``pii`` is an array of (start, rank, stop, kind, points), sorted by start and then by the order
    of ``kinds``; places are code points, the stop is exclusive. Kinds may overlap, matches of one
    kind do not. NULL and empty texts have no spans, NULL ids pass, repeated rows give repeated
    results, other columns are ignored, an empty table gives an empty result. The search is linear
    in the text, so very long texts and texts full of matches take their share of time only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = [_spans_of(kind, rank, text, min_points) for rank, kind in enumerate(kinds)]
    return df.select(F.col(id_col), F.array_sort(F.concat(*spans)).alias("pii"))


def digest(found: DataFrame, id_col: str = "doc_id", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Counts and digests of the base spans, and all spans as text."""
    base = [k.name for k in kinds if k.base]

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
        )

    def count(name: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select(
        id_col, *(count(name) for name in base),
        F.sha2(listed(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
    )

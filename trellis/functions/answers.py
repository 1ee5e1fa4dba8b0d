"""Functions of answers and evidence: availability, truncation, cost, event lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellis.functions.text import contains_any, unfence

# Phrases of an answer that honestly says nothing, and markers of one without information.
UNAVAILABLE = ["ne contient pas", "aucun", "pas disponible", "impossible de répondre"]
NO_INFORMATION = ["pas disponible", "non disponible", "aucune information", "pas d'information", "ne dispose pas", "n'est pas disponible", "aucune donnée", "pas de données", "n'y a pas d'informations"]
# Price of 1,000 tokens in and out, and of an embedded token.
PRICE_IN, PRICE_OUT, PRICE_EMBEDDED = 0.00015, 0.0006, 0.00002
#: What a passage ends with that was cut.
CUT = "…[truncated]"


def once(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)



def is_unavailable(answer: Column, phrases: list[str] = UNAVAILABLE) -> Column:
    """An answer that says it has none. A missing or blank answer says nothing, so it is none of these."""
    return F.coalesce(contains_any(F.lower(answer), phrases), F.lit(False))


def is_no_information(answer: Column) -> Column:
    return is_unavailable(answer, NO_INFORMATION)


def tokens_of(text: Column) -> Column:
    """A rough estimate: four characters a token."""
    return F.coalesce(F.floor(F.length(text) / 4), F.lit(0)).cast("long")


def cost(text_in: Column, text_out: Column) -> Column:
    return tokens_of(text_in) / 1000 * PRICE_IN + tokens_of(text_out) / 1000 * PRICE_OUT


def embedding_cost(text: Column) -> Column:
    """Tokens times the price, which is one of single tokens here (unlike those of ``cost``)."""
    return F.coalesce(F.length(text), F.lit(0)) / 4 * PRICE_EMBEDDED


def truncate_passages(passages: Column, limit: int) -> Column:
    """Passages with at most ``limit`` characters together. If they have more, each is cut to its share (one
    character at least) and marked; then the longest lose characters, the first of equals first, until all fit."""
    texts = F.transform(passages, lambda p: F.coalesce(p, F.lit("")))
    zero = F.lit(0).cast("long")
    sum_of = lambda lengths: F.aggregate(lengths, zero, lambda a, x: a + x)

    def shorten(x: Column) -> Column:
        total = sum_of(F.transform(x, lambda p: F.length(p).cast("long")))
        keep = lambda p: F.greatest(F.lit(1), F.floor(F.length(p) * F.lit(limit) / total)).cast("int")
        cut = F.transform(x, lambda p: F.when(F.length(p) > keep(p), F.concat(p.substr(F.lit(1), keep(p)), F.lit(CUT))).otherwise(p))
        return F.when(total <= limit, x).otherwise(once(cut, level))

    def level(x: Column) -> Column:
        """All lengths above a level come down to it, some to one more, so that the sum is the limit."""
        lengths = F.transform(x, lambda p: F.length(p).cast("long"))
        n = F.size(x)
        ordered = F.sort_array(lengths)
        # how many of the shortest stay whole: those for which all longer ones cut to their length fit
        whole = F.aggregate(
            ordered, F.struct(zero.alias("sum"), zero.alias("count")),
            lambda a, v: F.when(a["sum"] + v * (n - a["count"]) <= limit, F.struct((a["sum"] + v).alias("sum"), (a["count"] + 1).alias("count"))).otherwise(a),
        )
        return once(whole, lambda w: F.when(w["count"] == n, x).otherwise(at_most(x, F.floor((limit - w["sum"]) / (n - w["count"])), (limit - w["sum"]) % (n - w["count"]))))

    def at_most(x: Column, most: Column, more: Column) -> Column:
        """The last ``more`` of the passages longer than ``most`` keep one character above it."""
        longer = F.transform(x, lambda p: (F.length(p) > most).cast("int"))
        after = lambda i: F.aggregate(F.slice(longer, i + 2, F.greatest(F.size(longer) - i - 1, F.lit(0))), F.lit(0), lambda a, v: a + v)
        return F.transform(x, lambda p, i: F.when(F.length(p) > most, p.substr(F.lit(1), F.greatest(F.lit(1), (most + F.when(after(i) < more, 1).otherwise(0)).cast("int")))).otherwise(p))

    return once(texts, shorten)


#: Dimensions of a judgement.
SCORES = ("groundedness", "completeness", "relevance")


def judge_scores(reply: Column) -> Column:
    """A judge's reply as a struct: three scores and ``error`` (null if it is valid). The object may stand in a
    fence or in prose; each score must be there, be a number (or a text of one), and lie between 0 and 1."""
    def read(inside: Column) -> Column:
        return once(F.struct(inside.alias("text"), F.try_parse_json(F.nullif(inside, F.lit(""))).alias("json")), scores)

    def scores(x: Column) -> Column:
        raw = [F.try_variant_get(x["json"], f"$.{k}", "string").alias(k) for k in SCORES]
        numbers = [F.try_variant_get(x["json"], f"$.{k}", "string").try_cast("double").alias(f"{k}_value") for k in SCORES]
        return once(F.struct((x["text"] == "").alias("none"), x["json"].isNull().alias("broken"), *raw, *numbers), checked)

    def checked(x: Column) -> Column:
        error = F.when(x["none"], "no object").when(x["broken"], "no JSON")
        for k in SCORES:
            value = x[f"{k}_value"]
            error = error.when(x[k].isNull(), f"{k} is missing").when(value.isNull() | F.isnan(value), f"{k} is no number").when(~value.between(0, 1), f"{k} is out of range")
        return once(error, lambda e: F.struct(*[F.when(e.isNull(), x[f"{k}_value"]).alias(k) for k in SCORES], e.alias("error")))

    return once(F.regexp_extract(F.coalesce(unfence(reply), F.lit("")), r"(?s)(\{.*\})", 1), read)


def fit_passages(passages: Column, limit: int) -> Column:
    """Passages cut so that together they have at most ``limit`` characters, each in proportion to its
    length (rounded down, so the sum never exceeds the limit); short enough lists stay as they are."""
    total = F.aggregate(passages, F.lit(0).cast("long"), lambda a, p: a + F.length(p))
    cut = F.transform(passages, lambda p: F.substring(p, F.lit(1), F.floor(F.length(p) * F.lit(limit) / F.greatest(total, F.lit(1))).cast("int")))
    return F.when(total <= limit, passages).otherwise(cut)


def event_lines(text: Column, none: str = "NONE") -> Column:
    """Structs of the lines 'name | date | place | details' (four parts at least, in any line with a bar);
    lines that say there is none are skipped."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("|") & ~F.upper(x).contains(none) & (F.size(F.split(x, r"\|")) >= 4))
    part = lambda x, i: F.trim(F.get(F.split(x, r"\|"), F.lit(i)))
    return F.transform(lines, lambda x: F.struct(part(x, 0).alias("name"), part(x, 1).alias("date"), part(x, 2).alias("place"), part(x, 3).alias("details")))

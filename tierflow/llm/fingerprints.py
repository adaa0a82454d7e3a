"""Order MinHash document fingerprints, in DataFrame functions only.

A text is a sequence of tokens (words, long ones in parts), its k-mers numbered by occurrence. One hash puts
(k-mer, occurrence) on a ring. Each of the signature's components starts at a point of its own on the ring and takes the next
``keep`` k-mers, that is the minimal ones under one rotation of the order; they are put in text order and hashed together. So a component agrees if the
same k-mers are minimal and stand in the same order, which edit distance preserves and reordering does not. Short
texts fill all components, as rotations reuse their k-mers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tierflow.llm.common import parts
from tierflow.operators.scale import staged

K, KEEP, COMPONENTS = 2, 2, 64
HEX = 4  # digits of a component
PLACE_BITS = 30
_PLACE = (1 << PLACE_BITS) - 1
TOKEN = r"[\p{L}\p{N}_]{1,12}|[^\p{L}\p{N}_\s]{1,12}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def order_minhash(text: Column, k: int = K, keep: int = KEEP, components: int = COMPONENTS) -> Column:
    """Signature of a text: HEX digits for each component. Texts without tokens have a signature of zeros."""
    words = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))

    def kmers(h: Column) -> Column:
        n = F.greatest(F.size(h) - F.lit(k - 1), F.least(F.size(h), F.lit(1)))
        # hash above, place below: one sort brings equal k-mers together, in text order
        return F.transform(F.slice(h, 1, n), lambda x, i: _above(_mixed(h, x, i, k)) .bitwiseOR(i.cast("bigint") + 1))

    def numbered(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.transform(s, lambda v, i: F.when((i == 0) | (_above(v) != _above(F.get(s, i - 1))), i).otherwise(-1)),
                          lambda i: i >= 0)
        return let(starts, lambda r: F.flatten(F.transform(r, lambda a, j: F.sequence(F.lit(0), F.coalesce(F.get(r, j + 1), n) - a - 1))))

    def ring(s: Column) -> Column:
        return let(numbered(s), lambda occ: F.transform(s, lambda v, i: _above(F.xxhash64(_above(v), F.get(occ, i))).bitwiseOR(_place(v))))

    marks = F.transform(F.sequence(F.lit(0), F.lit(components - 1)),
                        lambda j: F.shiftleft(j.cast("bigint") - components // 2, 64 - components.bit_length() + 1))

    def signature(y: Column) -> Column:
        n = F.size(y)
        both = F.sort_array(F.concat(y, marks))  # marks have place 0, so a mark comes before what follows its point
        at = F.filter(F.transform(both, lambda v, i: F.when(_place(v) == 0, i).otherwise(-1)), lambda i: i >= 0)
        own = F.filter(both, lambda v: _place(v) != 0)

        def component(o: Column, p: Column, j: Column) -> Column:
            taken = F.transform(F.sequence(F.lit(0), F.least(F.lit(keep), n) - 1), lambda d: F.get(o, (p - j + d) % n))
            # place above, hash below: a sort of so few puts them in text order
            ordered = F.sort_array(F.transform(taken, lambda v: F.struct(_place(v).alias("p"), _above(v).alias("h"))))
            return F.substring(F.lpad(F.hex(F.xxhash64(F.concat_ws(",", F.transform(ordered, lambda x: x["h"].cast("string"))))), 16, "0"), 1, HEX)

        return let(own, lambda o: let(at, lambda a: F.concat_ws("", F.transform(a, lambda p, j: component(o, p, j)))))

    made = let(words, lambda h: let(F.sort_array(kmers(h)), lambda s: let(ring(s), signature)))
    return F.when(F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))) == 0, "0" * HEX * components).otherwise(made)


def _mixed(h: Column, x: Column, i: Column, k: int) -> Column:
    return F.xxhash64(x, *(F.get(h, i + d) for d in range(1, k)))


def _above(v: Column) -> Column:
    return v.bitwiseAND(F.lit(~_PLACE))


def _place(v: Column) -> Column:
    return v.bitwiseAND(F.lit(_PLACE))


def likeness(a: Column, b: Column, components: int = COMPONENTS) -> Column:
    """Share of equal components."""
    same = F.filter(F.sequence(F.lit(0), F.lit(components - 1)),
                    lambda j: F.substring(a, j * HEX + 1, F.lit(HEX)) == F.substring(b, j * HEX + 1, F.lit(HEX)))
    return F.size(same) / F.lit(float(components))


def fingerprints(docs: DataFrame, k: int = K, keep: int = KEEP, components: int = COMPONENTS) -> DataFrame:
    """doc_id, text and fingerprint, one row per row of ``docs``.

    Equal texts have equal fingerprints. A null text is empty; a text without tokens has a fingerprint of zeros; one with fewer
    tokens than ``k`` has one k-mer; a null doc_id stays null; repeated rows are kept; an empty table gives no rows; other columns are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("fingerprint", order_minhash(F.col("text"), k, keep, components))


def with_next(rows: DataFrame, take: dict[str, str]) -> DataFrame:
    """Adds columns of the next row by falling doc_id (nulls last; after the last row the first one's).

    Rows are cut into ranges of doc_id; the first row of each range also goes to the range before it, so a
    local window sees its neighbour. ``take`` maps a column to the name that its next value gets.
    """
    ids = rows.select("doc_id").where("doc_id is not null")
    n = parts(rows.sparkSession) * 2
    found = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("q")).first()["q"] or []
    cuts = sorted(set(found))  # as many as partitions, whatever the table's size
    number = F.lit(len(cuts) + 1)
    # bucket 0 has the largest ids; null ids come last
    bucket = F.when(F.col("doc_id").isNull(), number).otherwise(
        F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>"), lambda c: c >= F.col("doc_id"))))
    placed = rows.withColumn("__b", bucket)
    tops = placed.groupBy("__b").agg(F.max("doc_id").alias("top")).collect()  # one row a range
    have = sorted(r["__b"] for r in tops)
    before = {b: have[i - 1] for i, b in enumerate(have)}
    top = {r["__b"]: r["top"] for r in tops}
    if not have:
        return rows.withColumns({v: F.col(c) for c, v in take.items()})
    lead_to = F.lit(None).cast("int")
    pairs = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(top[b]).cast("bigint").alias("t"), F.lit(before[b]).alias("to")) for b in have])
    found_to = F.filter(pairs, lambda x: (x["b"] == F.col("__b")) & x["t"].eqNullSafe(F.col("doc_id")))
    lead_to = F.when(F.size(found_to) > 0, found_to[0]["to"])
    copies = placed.withColumn("__to", F.explode(F.when(lead_to.isNotNull(), F.array(
        F.struct(F.col("__b").alias("b"), F.lit(False).alias("halo")), F.struct(lead_to.alias("b"), F.lit(True).alias("halo"))))
        .otherwise(F.array(F.struct(F.col("__b").alias("b"), F.lit(False).alias("halo"))))))
    w = Window.partitionBy("__to.b").orderBy("__to.halo", F.col("doc_id").desc_nulls_last(), *[F.col(c) for c in take])
    out = copies.withColumns({v: F.lead(c).over(w) for c, v in take.items()})
    return out.where("not __to.halo").drop("__b", "__to")


def edited(text: Column, other: Column) -> Column:
    """The last third of a text replaced by as many characters of another."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(other, F.lit(1), third))

"""Addresses in networks: an interval join of addresses with a table of ranges, by leading bits, for both families.

An address is (family, hi, lo): 128 bits as two longs whose signed order is the order of the bits; an IPv4 address is in the last 32. A range
lies under the leading bits that its ends have in common, in steps of 8: one row, however wide it is. An address looks under its own
leading bits at every length that the table has, 17 at most, and the interval decides. Expressions only; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let

STEP = 8
#: Ranges up to this number (counted) are broadcast; more are joined by a shuffle, where skewed keys are split.
MOST_SENT = 1 << 17
SIGN = -(1 << 63)


def _v4(text: Column) -> Column:
    """The 32 bits of a dotted address as a long, null if it is none."""
    n = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: F.when(p.cast("int") < 256, acc * 256 + p.cast("long")))
    return F.when(text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), n(F.split(text, r"\.")))


def _struct(hi: Column, lo: Column, family: int) -> Column:
    return F.struct(F.lit(family).alias("family"), hi.bitwiseXOR(F.lit(SIGN)).alias("hi"), lo.bitwiseXOR(F.lit(SIGN)).alias("lo"))


def _v6(text: Column) -> Column:
    """An IPv6 address, its groups as text between colons; each value is bound once (``let``), so that it is worked out once."""
    groups = lambda half: F.when(half == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(half, ":"))
    long = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda acc, g: F.shiftleft(acc, 16).bitwiseOR(F.conv(g, 16, 10).cast("long")))

    def filled(h: Column) -> Column:
        """h: the groups before and after ``::``; one side alone where there is none."""
        missing = 8 - F.aggregate(h, F.lit(0), lambda acc, x: acc + F.size(x))
        fits = ((F.size(h) == 1) & (missing == 0)) | ((F.size(h) == 2) & (missing >= 1))
        return F.when(fits, F.concat(h[0], F.array_repeat(F.lit("0"), missing), F.coalesce(F.get(h, F.lit(1)), F.expr("cast(array() as array<string>)"))))

    value = lambda all_: F.when(F.forall(all_, lambda g: g.rlike("^[0-9a-f]{1,4}$")), _struct(long(F.slice(all_, 1, 4)), long(F.slice(all_, 5, 4)), 6))
    return let(F.transform(F.split(text, "::", -1), groups), lambda h: let(filled(h), value))


def address(text: Column) -> Column:
    """struct(family, hi, lo) of an address as text, null if it is none. Zones (``%eth0``) don't count; a dotted end of an IPv6 address is its last 32 bits."""
    plain = F.lower(F.trim(F.regexp_replace(text, "%.*$", "")))
    hexed = lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF)))))

    def of(t: Column) -> Column:
        end = F.regexp_extract(t, r"(\d{1,3}(?:\.\d{1,3}){3})$", 1)
        six = let(end, lambda e: F.when(e == "", t).otherwise(F.concat(F.left(t, F.length(t) - F.length(e)), let(_v4(e), hexed))))
        four = let(_v4(t), lambda n: F.when(n.isNotNull(), _struct(F.lit(0).cast("long"), n, 4)))
        return F.when(F.contains(t, F.lit(":")), let(six, _v6)).otherwise(four)

    return let(plain, of)


def _mask(bits: Column) -> Column:
    """A long with its first ``bits`` bits set (0 to 64)."""
    return F.when(bits <= 0, F.lit(0).cast("long")).when(bits >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - bits).cast("int")))


def _leading(a: Column, bits: Column) -> Column:
    """The first ``bits`` of the 128 as text; the family is told apart elsewhere."""
    cut = lambda x, n: x.bitwiseXOR(F.lit(SIGN)).bitwiseAND(_mask(n))
    return F.concat_ws(":", cut(a["hi"], bits), cut(a["lo"], bits - 64))


def networks(rows: DataFrame, cidr: str) -> DataFrame:
    """rows with first, last (see ``address``), ``prefix`` (the length of the network) and ``level`` and ``bucket`` (where it lies). Rows that are no network are left out; host bits count as zero."""
    text, length = F.split_part(F.col(cidr), F.lit("/"), F.lit(1)), F.split_part(F.col(cidr), F.lit("/"), F.lit(2))
    told = rows.withColumns({"__at": address(text), "__n": F.when(length.rlike(r"^\d{1,3}$"), length.try_cast("int"))})
    width = F.when(F.col("__at.family") == 4, 32).otherwise(128)
    told = told.withColumn("prefix", F.coalesce("__n", F.when(~F.contains(F.col(cidr), F.lit("/")), width))).where(F.col("__at").isNotNull() & (F.col("prefix") <= width))
    bits = F.col("prefix") + 128 - width
    part = lambda x, n: F.col(f"__at.{x}").bitwiseXOR(F.lit(SIGN)).bitwiseAND(_mask(n))
    ends = lambda upper: F.struct(F.col("__at.family").alias("family"), *[(part(x, n).bitwiseOR(F.bitwise_not(_mask(n))) if upper else part(x, n)).bitwiseXOR(F.lit(SIGN)).alias(x) for x, n in (("hi", bits), ("lo", bits - 64))])
    level = F.floor(bits / STEP).cast("int") * STEP
    made = told.select(*rows.columns, "prefix", ends(False).alias("first"), ends(True).alias("last"), level.alias("level"))
    return made.withColumn("bucket", _leading(F.col("first"), F.col("level")))


def within(rows: DataFrame, text: str, nets: DataFrame, *columns: str) -> DataFrame:
    """rows with the columns and ``prefix`` of the most specific network that holds the address in ``text``; null where none does or it is no address.

    ``nets`` as ``networks`` makes them. Of equal networks the one whose columns come first holds.
    """
    levels = [r.level for r in nets.select("level").distinct().collect()]  # 17 at most
    n = nets.limit(MOST_SENT + 1).count()
    key = rows.withColumn("__at", address(F.col(text))).withColumn("__id", F.monotonically_increasing_id())
    if not levels:
        return rows.select("*", *[F.lit(None).cast(nets.schema[c].dataType).alias(c) for c in (*columns, "prefix")])
    order = F.struct(F.col("prefix").alias("prefix"), *[F.col(c) for c in columns])
    best = nets.groupBy("first", "last", "level", "bucket").agg(F.min(order).alias("net")).select(F.col("first.family").alias("__family"), "level", "bucket", F.struct("first.hi", "first.lo").alias("__first"), F.struct("last.hi", "last.lo").alias("__last"), "net")
    tries = key.select("*", F.explode_outer(F.when(F.col("__at").isNotNull(), F.array(*map(F.lit, levels)))).alias("__level"))
    tries = tries.withColumn("__bucket", _leading(F.col("__at"), F.col("__level"))).withColumn("__here", F.struct("__at.hi", "__at.lo"))
    best = F.broadcast(best) if n <= MOST_SENT else best
    on = (F.col("__at.family") == F.col("__family")) & (F.col("__level") == F.col("level")) & (F.col("__bucket") == F.col("bucket")) & (F.col("__here") >= F.col("__first")) & (F.col("__here") <= F.col("__last"))
    met = tries.join(best, on, "left")
    chosen = met.groupBy("__id").agg(*[F.first(c).alias(c) for c in rows.columns], F.max_by("net", "net.prefix").alias("net"))
    return chosen.select(*rows.columns, *[F.col(f"net.{c}").alias(c) for c in (*columns, "prefix")])

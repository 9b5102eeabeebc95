"""Interval overlap join of sales with click sessions, totals by relation.

Clicks become sessions without a row of theirs being sorted: clicks in one slice of time as long as the gap can't lie in different
sessions, so slices are aggregated first (before they are shuffled), and only slices are put in order. A client has at most one slice,
and at most one session, in ten minutes (52,560 a year) however many clicks it has.

Within a client the sessions that have ended follow one another, so both their starts and their ends are monotone: ``searchsorted`` cuts
the nine ranges of a sale's relations and differences of prefix sums give their totals, no pair is made. Sessions without an end are
in a second sorted array, of starts alone. All sales of an Arrow batch are cut at once, with the client before the slot in one key.

A client's sales are dealt to as many parts as keep a part near ``PART`` rows, its sessions to each of them. How many those are is
joined through ``SPREAD`` places, so a client with a third of all sales isn't in one task there either. Nothing is broadcast or collected.

Defined results: rows without a client or time, and lines without a sale, are passed over; repeated clicks change nothing; a repeated row
of ``sales`` is a sale of its own; a sale without lines ends when it was sold; a time before 1970 has a negative slot; empty tables give
an empty one; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import stash

GAP_US = 600_000_000
SLOT_US = 3_600_000_000
#: Sales of a client in one part.
PART = 16_384
#: Places through which a client's number of parts reaches its sales.
SPREAD = 64
#: By how a sale starts (before, with, after the session), then by how it ends.
RELATIONS = ("overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by")
SCHEMA = "sale_id long, relation string, n_pairs long, overlap_slots long, sessions_crc long"
#: Slots lie within +- this many hours of 1970, some 15,000 years.
REACH = 1 << 27


def micros(rows: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time; one without a zone is taken as UTC whatever the session's zone."""
    column = F.col(name)
    if dict(rows.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(column.cast("timestamp"))
    within = F.hour(column) * 3600 + F.minute(column) * 60
    return (F.unix_date(column.cast("date")).cast("long") * 86_400 + within) * 1_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("long")


def floored(us: str, width: int) -> Column:
    return F.expr(f"({us} - pmod({us}, {width}L)) div {width}L")


def sessions(clicks: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """(client_id, first_us, last_us, open): a click over ``gap_us`` after the one before it begins another session.

    A session is open if a click at its last time is a purchase.
    """
    buys = F.coalesce(F.col("kind") == "purchase", F.lit(False)).cast("long")
    times = clicks.select("client_id", micros(clicks, "ts").alias("us"), buys.alias("buys")).where("client_id IS NOT NULL AND us IS NOT NULL")
    # The purchase mark as the last bit of the time: the greatest of both in one number, which Spark aggregates in place.
    slices = times.groupBy("client_id", floored("us", gap_us).alias("slice")).agg(F.min("us").alias("first_us"), F.max(F.col("us") * 2 + F.col("buys")).alias("last"))
    before = F.lag(F.shiftright("last", 1)).over(_by_time())
    begins = F.coalesce(F.col("first_us") - before > gap_us, F.lit(True)).cast("long")
    numbered = slices.withColumn("begins", begins).withColumn("session", F.sum("begins").over(_by_time()))
    found = numbered.groupBy("client_id", "session").agg(F.min("first_us").alias("first_us"), F.max("last").alias("last"))
    return found.select("client_id", "first_us", F.shiftright("last", 1).alias("last_us"), (F.col("last") % 2 != 0).alias("open"))


def _by_time():
    from pyspark.sql import Window

    return Window.partitionBy("client_id").orderBy("slice")


def sale_intervals(sales: DataFrame, lines: DataFrame, slot_us: int = SLOT_US) -> DataFrame:
    """(client_id, sale_id, starts, ends) in slots; ``ends`` is null if a line hasn't been shipped."""
    shipped = lines.where("sale_id IS NOT NULL").select("sale_id", micros(lines, "shipped_at").alias("us")).select("sale_id", floored("us", slot_us).alias("slot"))
    ends = shipped.groupBy("sale_id").agg(F.max("slot").alias("shipped"), F.max(F.col("slot").isNull()).alias("open"))
    sold = sales.select("client_id", F.col("sale_id").cast("long").alias("sale_id"), micros(sales, "sold_at").alias("us")).where("client_id IS NOT NULL AND us IS NOT NULL")
    sold = sold.select("client_id", "sale_id", floored("us", slot_us).alias("starts"))
    last = F.when(~F.coalesce("open", F.lit(False)), F.greatest("starts", "shipped"))
    return sold.join(ends.hint("merge"), "sale_id", "left").select("client_id", "sale_id", "starts", last.alias("ends"))


def session_overlaps(sales: DataFrame, lines: DataFrame, clicks: DataFrame, slot_us: int = SLOT_US) -> DataFrame:
    """SCHEMA: for each sale and relation, the same client's sessions that share a slot with it."""
    found = sessions(clicks)
    found = found.select(
        "client_id", floored("first_us", slot_us).alias("starts"), F.when(~F.col("open"), floored("last_us", slot_us)).alias("ends"), F.crc32(F.col("first_us").cast("string").cast("binary")).alias("value")
    )
    sold = sale_intervals(sales, lines, slot_us).withColumnRenamed("sale_id", "value")
    many = sales.where("client_id IS NOT NULL AND sold_at IS NOT NULL").groupBy("client_id").count().where(F.col("count") > PART)
    many = stash(many.select("client_id", F.ceil(F.col("count") / PART).cast("int").alias("parts")), "client-parts")
    return totals(*dealt(sold, found, many))


def dealt(sold: DataFrame, found: DataFrame, many: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each sale in one part of its client, each session in all of them."""
    spread = many.select("client_id", "parts", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("place"))
    place = F.pmod(F.xxhash64("value", "starts"), F.lit(SPREAD)).cast("int")
    sold = sold.withColumn("place", place).join(spread.hint("merge"), ["client_id", "place"], "left")
    # The remainder by 64 took the hash's last bits, so parts come from another hash.
    part = F.pmod(F.xxhash64("starts", "value"), F.coalesce("parts", F.lit(1))).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    found = found.join(many.hint("merge"), "client_id", "left").select("client_id", copies.alias("part"), "starts", "ends", "value")
    return sold.select("client_id", part.alias("part"), "starts", "ends", "value"), found


def totals(sold: DataFrame, found: DataFrame) -> DataFrame:
    """SCHEMA from sales and sessions of the same (client_id, part), each (starts, ends or null, value), the value a sale's id or a session's number."""
    rows = found.withColumn("kind", F.lit(0)).unionByName(sold.withColumn("kind", F.lit(1)))
    rows = rows.select("client_id", "part", "kind", "starts", "ends", "value").repartition("client_id", "part").sortWithinPartitions("client_id", "part", "kind", "starts", "ends")
    return rows.mapInArrow(_totals, SCHEMA)


def _numbers(column: pa.Array, missing: int = 0) -> np.ndarray:
    return column.fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sessions stand before the sales of their group; those of the last group are kept, as its sales may go on in the next batch."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        rows = rows.combine_chunks()
        kind, client, part = (_numbers(rows[c]) for c in ("kind", "client_id", "part"))
        group = np.concatenate([[0], np.cumsum((client[1:] != client[:-1]) | (part[1:] != part[:-1]))])
        sale = kind == 1
        kept = rows.filter(pa.array(~sale & (group == group[-1])))
        if sale.any():
            starts, ends, is_open = _numbers(rows["starts"]), _numbers(rows["ends"], REACH - 1), rows["ends"].is_null().to_numpy(zero_copy_only=False)
            value = _numbers(rows["value"])
            ids = rows["value"].filter(pa.array(sale)).combine_chunks()
            yield from _cut(ids, group, starts, ends, is_open, value, sale)


def _cut(ids: pa.Array, group: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_open: np.ndarray, value: np.ndarray, sale: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The totals of all sales of these groups; a place in an array is found by group, then slot."""

    def key(g: np.ndarray, slot: np.ndarray) -> np.ndarray:
        return g * (2 * REACH) + (slot + REACH)

    def summed(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(x)])

    closed, unending = ~sale & ~is_open, ~sale & is_open
    g, s, e, open_sale = group[sale], starts[sale], ends[sale], is_open[sale]
    a, b, o = key(group[closed], starts[closed]), key(group[closed], ends[closed]), key(group[unending], starts[unending])
    sum_a, sum_b, sum_v = summed(starts[closed]), summed(ends[closed]), summed(value[closed])
    sum_o, sum_w = summed(starts[unending]), summed(value[unending])
    first, last = np.searchsorted(a, key(g, -REACH)), np.searchsorted(a, key(g + 1, -REACH))
    before, upto = np.searchsorted(a, key(g, s)), np.searchsorted(a, key(g, s), "right")  # starts before the sale's, and with it
    ended, reached = np.searchsorted(b, key(g, s)), np.searchsorted(a, key(g, e), "right")  # over before it, and begun by its end
    sooner, equal = np.searchsorted(b, key(g, e)), np.searchsorted(b, key(g, e), "right")  # ended before its end, and with it
    # No session that has ended ends with or after a sale that hasn't.
    sooner, equal = np.where(open_sale, last, sooner), np.where(open_sale, last, equal)
    start_cuts = ((upto, reached), (before, upto), (first, before))
    end_cuts = ((equal, last), (sooner, equal), (first, sooner))
    # The same of sessions without an end.
    o_first, o_before, o_upto, o_reached = np.searchsorted(o, key(g, -REACH)), np.searchsorted(o, key(g, s)), np.searchsorted(o, key(g, s), "right"), np.searchsorted(o, key(g, e), "right")
    o_cuts = ((o_upto, o_reached), (o_before, o_upto), (o_first, o_before))
    for i, (lo, hi) in enumerate(start_cuts):
        o_lo, o_hi = o_cuts[i]
        o_n = np.maximum(o_hi - o_lo, 0)
        o_crc = np.where(o_n > 0, sum_w[o_hi] - sum_w[o_lo], 0)
        # A sale's slots from the later start on: a closed sale's with an open session.
        o_slots = np.where(o_n > 0, o_n * (e + 1) - (sum_o[o_hi] - sum_o[o_lo] if i == 0 else o_n * s), 0)
        for j, (least, most) in enumerate(end_cuts):
            left = np.maximum(np.maximum(lo, least), ended)
            right = np.maximum(np.minimum(np.minimum(hi, most), reached), left)
            n = right - left
            start_sum = sum_a[right] - sum_a[left] if i == 0 else n * s
            end_sum = sum_b[right] - sum_b[left] if j == 2 else n * e
            slots, crc, none = end_sum - start_sum + n, sum_v[right] - sum_v[left], np.zeros(len(n), bool)
            if j == 0:  # An open session ends after a closed sale,
                with_open = ~open_sale
                n, slots, crc = n + o_n * with_open, slots + o_slots * with_open, crc + o_crc * with_open
            elif j == 1:  # and with an open one, both without end.
                n, crc, none = n + o_n * open_sale, crc + o_crc * open_sale, open_sale
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array([RELATIONS[3 * i + j]] * len(at)), pa.array(n[at]), pa.array(slots[at], mask=none[at]), pa.array(crc[at])],
                    names=["sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc"],
                )


ORACLE = """
WITH clicked AS (
  SELECT client_id, epoch_us(ts) AS us, coalesce(kind = 'purchase', false) AS buys FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL
), begun AS (
  SELECT *, coalesce(us - lag(us) OVER (PARTITION BY client_id ORDER BY us) > 600000000, true) AS begins FROM clicked
), numbered AS (
  SELECT *, sum(begins::INT) OVER (PARTITION BY client_id ORDER BY us) AS session FROM begun
), spans AS (
  SELECT client_id, session, min(us) AS first_us, max(us) AS last_us, max(us) FILTER (buys) AS bought FROM numbered GROUP BY ALL
), steps AS (
  SELECT list(c ORDER BY n) AS step FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(n)
  )
), digests AS (
  SELECT client_id, first_us // 3600000000 AS starts, CASE WHEN bought IS NOT DISTINCT FROM last_us THEN NULL ELSE last_us // 3600000000 END AS ends,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(first_us::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                         lambda c, d: xor(step[(xor(c, d) % 256) + 1], c // 256)), 4294967295) AS crc
  FROM spans, steps
), shipped AS (
  SELECT sale_id, max(epoch_us(shipped_at)) AS us, bool_or(shipped_at IS NULL) AS open FROM sale_lines WHERE sale_id IS NOT NULL GROUP BY 1
), sold AS (
  SELECT s.sale_id, s.client_id, epoch_us(s.sold_at) // 3600000000 AS starts,
         CASE WHEN coalesce(l.open, false) THEN NULL ELSE greatest(epoch_us(s.sold_at), coalesce(l.us, epoch_us(s.sold_at))) // 3600000000 END AS ends
  FROM sales s LEFT JOIN shipped l USING (sale_id) WHERE s.client_id IS NOT NULL AND s.sold_at IS NOT NULL
), pairs AS (
  SELECT s.sale_id, s.starts AS s0, s.ends AS s1, d.starts AS d0, d.ends AS d1, d.crc
  FROM sold s JOIN digests d ON s.client_id = d.client_id AND (s.ends IS NULL OR d.starts <= s.ends) AND (d.ends IS NULL OR s.starts <= d.ends)
), named AS (
  SELECT *, sign(s0 - d0)::INT AS at_start, CASE WHEN s1 IS NULL AND d1 IS NULL THEN 0 WHEN s1 IS NULL THEN 1 WHEN d1 IS NULL THEN -1 ELSE sign(s1 - d1)::INT END AS at_end FROM pairs
)
SELECT sale_id, (['overlaps', 'finished_by', 'contains', 'starts', 'equals', 'started_by', 'during', 'finishes', 'overlapped_by'])[3 * (at_start + 1) + at_end + 2] AS relation,
       count(*)::BIGINT AS n_pairs, sum(CASE WHEN s1 IS NULL THEN d1 WHEN d1 IS NULL THEN s1 ELSE least(s1, d1) END - greatest(s0, d0) + 1)::BIGINT AS overlap_slots,
       sum(crc)::BIGINT AS sessions_crc
FROM named GROUP BY 1, 2
"""

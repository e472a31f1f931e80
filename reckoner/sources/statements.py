"""Raw statement files as cells (file, line, col, value): read from text, or rendered from a ledger."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

PREAMBLE_LINES, SAMPLE_LINES = 20, 20


def _cell(file: str, columns: list[tuple[str, str]], frame: str) -> str:
    return "\nUNION ALL ".join(f"SELECT {file} AS file, line, '{name}' AS col, {value} AS value FROM {{{frame}}}" for name, value in columns)


def _rupees(x: str) -> str:
    return f"concat(CAST(CAST(floor({x} / 100) AS bigint) AS string), '.', lpad(CAST({x} % 100 AS string), 2, '0'))"


def _day(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '' ELSE concat(lpad(CAST(day({x}) AS string), 2, '0'), '-', lpad(CAST(month({x}) AS string), 2, '0'), '-', CAST(year({x}) AS string)) END"


GATEWAY = [
    ("Txn Ref No", "entity_id"), ("Txn Type", "CASE WHEN type = 'payment' THEN 'Sale' WHEN type = 'refund' THEN 'Reversal' WHEN type = 'adjustment' THEN 'Chargeback' ELSE 'Split' END"),
    ("Gross Amount", _rupees("amount")), ("Amount Credited", _rupees("credit")), ("Amount Debited", _rupees("debit")), ("Commission", _rupees("fee")), ("Service Tax (GST)", _rupees("tax")),
    ("Payout Batch", "coalesce(settlement_id, '')"), ("Payout Date", _day("settled_on")), ("Bank Ref No", "coalesce(settlement_utr, '')"), ("Merchant Ref", "payment_id"), ("Order Ref", "order_id"),
    ("Instrument", "coalesce(method, '')"), ("Card Variant", "coalesce(card_type, '')"), ("Blocked", "CASE WHEN on_hold THEN 'Y' ELSE 'N' END"), ("Paid Out", "CASE WHEN settlement_id IS NULL THEN 'N' ELSE 'Y' END"), ("Txn Date", _day("created_on")),
]
BANK = [
    ("S No.", "CAST(line AS string)"), ("Value Date", _day("value_date")), ("Transaction Date", _day("value_date")), ("Cheque Number", "coalesce(utr, '')"), ("Transaction Remarks", "narration"),
    ("Withdrawal Amount (INR )", "CASE WHEN amount % 10 = 0 THEN '0' ELSE '0.00' END"), ("Deposit Amount (INR )", f"CASE WHEN amount % 3 = 0 THEN concat('Rs. ', {_rupees('amount')}) WHEN amount % 3 = 1 THEN concat({_rupees('amount')}, ' Cr') ELSE {_rupees('amount')} END"),
    ("Balance (INR )", _rupees("balance")),
]
PAYMENTS = [("payment_id", "payment_id"), ("order_id", "order_id"), ("amount", _rupees("amount")), ("currency", "'INR'"), ("method", "method"), ("card_type", "coalesce(card_type, '')"), ("captured_at", "CAST(captured_on AS string)")]
ORDERS = [("order_id", "order_id"), ("receipt", "order_receipt"), ("amount", _rupees("amount")), ("currency", "currency"), ("created_at", "CAST(created_on AS string)")]

BODIES = {
    "gateway_lines": "SELECT r.*, CAST(row_number() OVER (PARTITION BY merchant_id ORDER BY created_on, entity_id) AS bigint) AS line FROM {settlement_rows} r",
    "bank_lines": "SELECT b.*, CAST(sum(amount) OVER (PARTITION BY merchant_id ORDER BY line) AS bigint) AS balance FROM (SELECT c.*, CAST(row_number() OVER (PARTITION BY merchant_id ORDER BY value_date, credit_id) AS bigint) AS line FROM {bank_credits} c) b",
    "payment_lines": "SELECT p.*, CAST(row_number() OVER (PARTITION BY merchant_id ORDER BY payment_id) AS bigint) AS line FROM {payments} p",
    "order_lines": "SELECT o.*, CAST(row_number() OVER (PARTITION BY merchant_id ORDER BY order_id) AS bigint) AS line FROM {ledger_orders} o",
    "cells": "\nUNION ALL ".join(
        _cell(f"concat('{kind}_', CAST(merchant_id AS string))", columns, frame)
        for kind, columns, frame in (("gateway", GATEWAY, "gateway_lines"), ("bank", BANK, "bank_lines"), ("payments", PAYMENTS, "payment_lines"), ("orders", ORDERS, "order_lines"))
    ),
}


KINDS = {"gateway": (GATEWAY, "gateway_lines"), "bank": (BANK, "bank_lines"), "payments": (PAYMENTS, "payment_lines"), "orders": (ORDERS, "order_lines")}


def render_table(spark, sf_dir: str, kind: str) -> DataFrame:
    """Statements of one kind as a table (file, line, and their columns by name), for each merchant of a folder's derived ledger."""
    from .ledger import frames_of

    frames = frames_of(spark, sf_dir)
    columns, frame = KINDS[kind]
    body = BODIES[frame]
    # few bytes of rows become many cells: dealt to as many tasks as a shuffle has, none joined afterwards
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = spark.sql(body, **{x: frames[x].repartition(tasks, "merchant_id") for x in set(re.findall(r"\{(\w+)\}", body))})
    return made.select(F.concat(F.lit(f"{kind}_"), F.col("merchant_id").cast("string")).alias("file"), "line", *[F.expr(value).alias(name) for name, value in columns])


def render(spark, sf_dir: str, *kinds: str) -> DataFrame:
    """The same as cells (file, line, col, value), of some kinds or of all. A kind is numbered and read once, not once for each column."""
    return functools.reduce(DataFrame.unionByName, [flat(render_table(spark, sf_dir, kind)) for kind in kinds or KINDS])


def names_in(df: DataFrame) -> list[str]:
    """The statement's own columns of a table."""
    return [c for c in df.columns if c not in ("file", "line")]


def is_table(df: DataFrame) -> bool:
    """Whether lines are given as a table, not as cells (file, line, col, value)."""
    return not {"col", "value"} <= set(df.columns)


def stacked(names: list[str]) -> Column:
    """The columns of a table as rows (col, value)."""
    return F.inline(F.array(*[F.struct(F.lit(n).alias("col"), F.col(f"`{n}`").alias("value")) for n in names]))


def flat(df: DataFrame) -> DataFrame:
    """Cells (file, line, col, value) from a table; cells stay as they are."""
    return df.select("file", "line", stacked(names_in(df))) if is_table(df) else df


def once(*columns: Column) -> Column:
    """Columns that are computed once, however often they are used."""
    return F.inline(F.array(F.struct(*columns)))


BLOCK_LINES = 1 << 16  # lines of a file that one task scans
LONGEST_FIELD = 131_072  # characters; what is longer comes from a quote that nothing closes


def _inside_after(text: Column, sep: str) -> tuple[Column, Column]:
    """Whether a quoted field is still open after a line, if none was before it, and if one was.

    A quote opens a field only as its first character; inside, two quotes are one.
    """
    quoted = r'[^"]*+(?:""[^"]*+)*+'
    field = rf'(?:"{quoted}"[^{sep}]*+|[^{sep}"][^{sep}]*+|)'
    opened = rf'^(?:{field}{sep})*+"{quoted}$'
    closing = rf'^{quoted}"[^{sep}]*+{sep}?'
    after = F.regexp_replace(text, closing, "")
    return text.rlike(opened), ~text.rlike(rf'^{quoted}"') | (after.rlike(opened) & text.rlike(rf"{closing}"))


def records(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """Lines (file, line, text) as records: a quoted line break does not end one. line: the record's last.

    Where no line of a file, begun outside quotes, leaves one open, each is a record; only
    other files' lines are put together.
    """
    free, _ = _inside_after(F.col("text"), re.escape(delimiter))
    broken = cut(lines.filter(free).select("file").distinct())
    plain = lines.select("file", "line", F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("refused"))
    if not broken.take(1):
        return plain
    return _glued(lines.join(broken, "file", "left_semi"), delimiter).unionByName(plain.join(broken, "file", "left_anti"))


def _glued(lines: DataFrame, delimiter: str) -> DataFrame:
    """Records of files with quoted line breaks.

    What a line does to an open quote is one of four functions of two states. They are
    composed over blocks of lines, then over a file's blocks, of which there are few, and
    carried back, so that no task needs a whole file. A file whose last quote is never
    closed, or opens a field of more than LONGEST_FIELD characters, gives one row with
    refused set instead.
    """
    free, held = _inside_after(F.col("text"), re.escape(delimiter))
    known = lines.select("file", "line", "text", F.floor(F.col("line") / BLOCK_LINES).alias("block"), free.alias("free"), held.alias("held"))
    order = Window.partitionBy("file", "block").orderBy("line")
    before, until = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    turns = F.col("free") & ~F.col("held")
    known = known.withColumn("turned", F.sum(turns.cast("int")).over(until))
    fixed = F.when(F.col("free") == F.col("held"), F.struct(F.col("free").alias("to"), F.col("turned").alias("at")))

    def state(fixed: Column, turned: Column, carried: Column) -> Column:
        """Of the last line that leaves one state whatever was before, and how often it turned since."""
        return F.coalesce(fixed["to"], carried) != ((turned - F.coalesce(fixed["at"], F.lit(0))) % 2 == 1)

    known = known.withColumn("fixed", fixed)
    seen = known.withColumn("fixed_before", F.last("fixed", ignorenulls=True).over(before)).withColumn("turned_before", F.coalesce(F.lag("turned").over(order), F.lit(0)))
    of_block = F.max_by(F.struct(F.col("fixed"), F.col("turned")), "line")
    blocks = known.withColumn("fixed", F.last("fixed", ignorenulls=True).over(until)).groupBy("file", "block").agg(of_block.alias("end"))
    by_block = Window.partitionBy("file").orderBy("block")
    ends = blocks.select("file", "block", F.col("end.fixed").alias("fixed"), F.col("end.turned").alias("turned"))
    # a block with a fixed line ends as that says; others turn what they are given
    to = F.when(F.col("fixed").isNotNull(), state(F.col("fixed"), F.col("turned"), F.lit(False)))
    ends = ends.withColumn("to", to).withColumn("total", F.sum(F.when(F.col("to").isNull(), F.col("turned")).otherwise(0)).over(by_block))
    last_to = F.last(F.when(F.col("to").isNotNull(), F.struct("to", F.col("total").alias("at"))), ignorenulls=True).over(by_block)
    ends = ends.withColumn("open", state(last_to, F.col("total"), F.lit(False)))
    carry = ends.select("file", "block", F.coalesce(F.lag("open").over(by_block), F.lit(False)).alias("carried"))
    starts = seen.join(carry, ["file", "block"]).select("file", "block", "line", "text", (~state(F.col("fixed_before"), F.col("turned_before"), F.col("carried"))).alias("starts"))
    starts = starts.withColumn("start", F.last(F.when(F.col("starts"), F.col("line")), ignorenulls=True).over(until))
    latest = starts.groupBy("file", "block").agg(F.max("start").alias("latest"))
    latest = latest.select("file", "block", F.last("latest", ignorenulls=True).over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    placed = starts.join(latest, ["file", "block"]).select("file", "line", "text", F.coalesce("start", "earlier").alias("start"))
    sizes = placed.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("size"))
    never = ends.groupBy("file").agg(F.max_by("open", "block").alias("open")).filter("open").select("file")
    huge = sizes.filter((F.col("n") > 1) & (F.col("size") > 128 * LONGEST_FIELD)).select("file")
    refused = never.unionByName(huge).distinct()
    glued = placed.join(refused, "file", "left_anti").groupBy("file", "start").agg(F.max("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    glued = glued.select("file", "line", "text", F.lit(False).alias("refused"))
    return glued.unionByName(refused.select("file", F.lit(0).cast("long").alias("line"), F.lit("").alias("text"), F.lit(True).alias("refused")))


def _cells_of(text: Column, sep: str) -> Column:
    """The fields of a record, unquoted and trimmed."""
    quoted = r'"[^"]*+(?:""[^"]*+)*+"'
    fields = F.regexp_extract_all(F.concat(F.lit(sep[-1]), text), F.lit(rf"{sep}({quoted}[^{sep}]*+|[^{sep}]*+)"), F.lit(1))
    inner = lambda c: F.concat(F.replace(F.regexp_extract(c, r'^"([^"]*+(?:""[^"]*+)*+)"', 1), F.lit('""'), F.lit('"')), F.regexp_replace(c, rf"^{quoted}", ""))
    return F.transform(fields, lambda c: F.regexp_replace(F.when(c.startswith('"'), inner(c)).otherwise(c), r"^\s+|\s+$", ""))


def read_rows(lines: DataFrame, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """Rows (file, line, values) of delimited text files (file, line, text), and the header (file, names) found in each.

    The header is the first of the leading records that is mostly words and whose
    shape most records below it share. Blank and repeated names are made distinct,
    short rows are filled, blank rows and closing one-cell rows are dropped. A file with
    a quote that nothing closes gives no rows.
    """
    sep = re.escape(delimiter)
    read = records(lines, delimiter).filter("NOT refused").select("file", "line", once(_cells_of(F.col("text"), sep).alias("cells")))
    filled = F.filter("cells", lambda c: c != "")
    rows = cut(read.select("*", F.size("cells").alias("width"), F.size(filled).alias("filled"), F.size(F.filter(filled, lambda c: c.rlike(r"\p{L}"))).alias("wordy"), F.exists("cells", lambda c: F.length(c) > LONGEST_FIELD).alias("torn")))
    # the header stands among the leading records, so that only those are put in order
    by_line = Window.partitionBy("file").orderBy("line")
    top = rows.withColumn("place", F.row_number().over(by_line)).filter(F.col("place") <= PREAMBLE_LINES + SAMPLE_LINES)
    top = top.withColumn("below", F.collect_list(F.when(F.col("filled") > 0, F.col("width"))).over(by_line.rowsBetween(1, SAMPLE_LINES)))
    agree = F.size(F.filter("below", lambda w: w == F.col("width")))
    header = (F.col("place") <= PREAMBLE_LINES) & (F.col("width") >= 2) & (F.col("filled") * 2 >= F.col("width")) & (F.col("wordy") * 2 >= F.col("filled")) & (F.size("below") > 0) & (agree * 2 >= F.size("below"))
    heads = top.filter(header).groupBy("file").agg(F.min(F.struct("line", "cells")).alias("head")).select("file", F.col("head.line").alias("head_line"), F.col("head.cells").alias("names"))
    numbered = F.transform("names", lambda n, i: F.when(n == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(n))
    heads = heads.withColumn("names", numbered)
    heads = heads.withColumn("names", F.transform("names", lambda n, i: F.when(F.array_position("names", n) < i + 1, F.concat(n, F.lit(" ("), (i + 1).cast("string"), F.lit(")"))).otherwise(n)))
    last = rows.groupBy("file").agg(F.max(F.when(F.col("filled") != 1, F.col("line"))).alias("last"), F.bool_or("torn").alias("torn")).filter("NOT torn").drop("torn")
    heads = cut(heads.join(last, "file"))
    body = rows.select("file", "line", "cells", "filled").join(heads.select("file", "head_line", "last", F.size("names").alias("columns")), "file").filter("line > head_line")
    body = body.filter((F.col("columns") < 3) | (F.col("line") <= F.coalesce("last", F.lit(0)))).filter("filled > 0")
    fitted = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda i: F.coalesce(F.get("cells", i), F.lit("")))
    values = F.when(F.size("cells") == F.col("columns"), F.col("cells")).otherwise(fitted)
    return body.select("file", "line", values.alias("values")), heads.select("file", "names")


def named_cells(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Cells (file, line, col, value) of rows (file, line, values) under their headers (file, names)."""
    named = rows.join(heads, "file").withColumn("pair", F.explode(F.arrays_zip("names", "values")))
    return named.select("file", "line", F.col("pair.names").alias("col"), F.col("pair.values").alias("value"))


def read_delimited(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """Cells of delimited text files (file, line, text), named by the header found in each."""
    return named_cells(*read_rows(lines, delimiter))

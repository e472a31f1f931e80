"""Column profiles of raw statement cells, and what a file's own values say its columns are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import apply_rate, parse_money, rate
from ..functions.text import normalise_name
from ..functions.vocabulary import CARD_TYPE, ENTITY, METHOD, PATTERNS, maybe_temporal, member_of, parse_bool, parse_temporal
from ..sources.session import cut
from ..sources.statements import flat, is_table, names_in, once, stacked

COLUMN = ["file", "col"]
CLEAN, CATEGORICAL, SPACEY, SAMPLES = 0.95, 0.90, 0.20, 4
MINIMUM_ROWS = 12
CONTAINED, QUOTED, QUOTED_CHARS = 0.98, 0.6, 8
MONEY_FIELDS = ("amount", "fee", "tax", "credit", "debit")
MOST_CANDIDATES, MOST_UNKNOWN = 12, 3
WORD_CHARS = 24  # longer values are read where they stand
CONFIDENT, ACCEPTABLE, DECISIVE = 0.75, 0.5, 1.5


def _filled(cells: DataFrame) -> DataFrame:
    return cells.filter(F.trim("value") != "")


def _parsed(v: Column) -> dict[str, Column]:
    """What each parser makes of a value, by the name of its share."""
    return {"money": parse_money(v), "boolean": parse_bool(v), "entity_type": member_of(v, ENTITY), "method": member_of(v, METHOD), "card_type": member_of(v, CARD_TYPE), "spacey": F.when(v.rlike(r"\s"), 1)}


def _share(name: str) -> Column:
    return F.coalesce(F.try_divide(F.sum(name), F.sum("filled")), F.lit(0.0)).alias(name)


def shares(cells: DataFrame) -> DataFrame:
    """total, filled, distinct and the share of filled values each parser reads, for each column. A value is read once, however often it stands there."""
    v, n = F.col("value"), F.col("n")
    values = cells.groupBy(*COLUMN, "value").agg(F.count(F.lit(1)).alias("n"))
    full = F.trim(v) != ""
    read = values.select(*COLUMN, n, F.when(full, n).otherwise(0).alias("filled"), *[F.when(full & parsed.isNotNull(), n).otherwise(0).alias(name) for name, parsed in _parsed(v).items()])
    return read.groupBy(*COLUMN).agg(F.sum("n").alias("total"), F.sum("filled").alias("filled"), F.count_if(F.col("filled") > 0).alias("distinct"), *[_share(name) for name in _parsed(v)])


def profile(cells: DataFrame) -> DataFrame:
    """The shares of each column with four sample values."""
    first = _filled(cells).groupBy(*COLUMN, "value").agg(F.min("line").alias("line"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(*COLUMN).orderBy("line", "value"))).filter(F.col("place") <= SAMPLES)
    samples = placed.groupBy(*COLUMN).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("samples"))
    return shares(cells).join(samples, COLUMN, "left")


def _readings() -> dict[str, Column]:
    return {p: parse_temporal(F.col("value"), p) for p in PATTERNS}


def _surviving(values: DataFrame) -> DataFrame:
    """The date patterns that read nearly all of a column. values: file, col, value (null: none that could be a date), filled."""
    counts = values.groupBy(*COLUMN).agg(F.sum("filled").alias("n"), *[F.coalesce(F.sum(F.when(r.isNotNull(), F.col("filled"))), F.lit(0)).alias(f"p{i}") for i, r in enumerate(_readings().values())])
    surviving = F.array_compact(F.array(*[F.when(F.col(f"p{i}") >= F.col("n") * CLEAN, F.lit(p)) for i, p in enumerate(PATTERNS)]))
    return counts.filter("n > 0").select(*COLUMN, surviving.alias("patterns")).filter("size(patterns) > 0")


def date_patterns(cells: DataFrame) -> DataFrame:
    """The date patterns that read nearly all of a column, and a value that two of them read differently.

    Only what has the outline of a date is read, and each such value of a column once.
    """
    v = F.col("value")
    return dates_in(cut(_filled(cells).groupBy(*COLUMN, F.when(maybe_temporal(v), v).alias("value")).agg(F.count(F.lit(1)).alias("filled"), F.min("line").alias("line"))))


def dates_in(values: DataFrame) -> DataFrame:
    kept = cut(_surviving(values))
    several = values.filter("value IS NOT NULL").join(kept.filter("size(patterns) > 1"), COLUMN)
    reading = F.array(*[F.when(F.array_contains("patterns", p), F.coalesce(r.cast("string"), F.lit("?"))) for p, r in _readings().items()])
    clash = several.filter(F.size(F.array_distinct(F.array_compact(reading))) > 1).groupBy(*COLUMN).agg(F.min_by("value", "line").alias("conflict"))
    return kept.join(clash, COLUMN, "left")


def seen_in(cells: DataFrame) -> DataFrame:
    """Counts of each column's cells by the values that could be a date, a word of a list, or a yes or no; all other values together (null).

    What `fitting` needs, from one pass. Values of the first sort are few, so each is read
    once after they are counted; the others are read where they stand.
    """
    v, n = F.col("value"), F.col("filled")
    word = (F.length(v) <= WORD_CHARS) & (~v.rlike("[0-9]") | (F.length(v) == 1))
    told = cells.select(*COLUMN, "line", "value", once((F.trim(v) != "").alias("full"), (word | maybe_temporal(v)).alias("alone")))
    told = told.withColumn("alone", F.col("full") & F.col("alone"))
    stands = F.when(F.col("full") & ~F.col("alone"), v)
    read = told.select(*COLUMN, "line", F.when(F.col("alone"), v).alias("seen"), "full", *[parsed.isNotNull().cast("int").alias(name) for name, parsed in _parsed(stands).items()])
    counted = read.groupBy(*COLUMN, "seen").agg(F.count_if("full").alias("filled"), F.min(F.when(F.col("full"), F.col("line"))).alias("line"), *[F.sum(name).alias(name) for name in _parsed(v)])
    counted = counted.withColumnRenamed("seen", "value")
    return counted.select(*COLUMN, "value", "filled", "line", *[F.when(v.isNull(), F.col(name)).when(parsed.isNotNull(), n).otherwise(0).alias(name) for name, parsed in _parsed(v).items()])


def fitting(cells: DataFrame, seen: DataFrame | None = None, dated: DataFrame | None = None) -> DataFrame:
    """The kinds each column's values could be, without a profile's distinct counts: those matter for yes or no alone, whose values are few.

    Where a column of yes and no holds other values as well, its distinct values are counted.
    """
    seen = cut(seen_in(cells)) if seen is None else seen
    own = F.col("value").isNotNull()
    profiles = cut(seen.groupBy(*COLUMN).agg(F.sum("filled").alias("filled"), F.count_if(own).alias("distinct"), F.sum(F.when(~own, F.col("filled")).otherwise(0)).alias("others"), *[_share(name) for name in _parsed(F.col("value"))]))
    unsure = profiles.filter((F.col("boolean") >= CLEAN) & (F.col("others") > 0) & (F.col("distinct") <= 2)).select(*COLUMN)
    if unsure.take(1):
        exact = _filled(cells).join(unsure, COLUMN, "left_semi").groupBy(*COLUMN).agg(F.count_distinct("value").alias("exact"))
        profiles = profiles.join(exact, COLUMN, "left").withColumn("distinct", F.coalesce("exact", "distinct")).drop("exact")
    return fits(profiles, _surviving(seen) if dated is None else dated)


def fits(profiles: DataFrame, dated: DataFrame) -> DataFrame:
    """The kinds each column's values could be: an empty column is none."""
    p = profiles.join(dated.select(*COLUMN, F.lit(True).alias("dated")), COLUMN, "left").filter("filled > 0")
    kinds = F.array_compact(F.array(
        F.when(F.col("money") >= CLEAN, "money"), F.when(F.col("dated"), "temporal"), F.when((F.col("boolean") >= CLEAN) & (F.col("distinct") <= 3), "boolean"),
        F.when(F.col("entity_type") >= CATEGORICAL, "entity_type"), F.when(F.col("method") >= CATEGORICAL, "payment_method"), F.when(F.col("card_type") >= CATEGORICAL, "card_type"),
        F.when(F.col("spacey") <= SPACEY, "identifier"), F.lit("text"),
    ))
    return p.select(*COLUMN, F.explode(kinds).alias("value_kind"))


def rank_kinds(fitting: DataFrame, fields: DataFrame) -> DataFrame:
    """How well each record kind explains each file: share of required fields named and of columns used; impossible kinds are left out.

    fields: kind, field, value_kind, required, alias.
    """
    target = fields.select("kind", "field", "value_kind", "required").distinct()
    kinds = fitting.select("file", "value_kind").distinct()
    needed = target.filter("required").groupBy("kind").agg(F.collect_set("value_kind").alias("needs"), F.count(F.lit(1)).alias("required_fields"))
    present = kinds.groupBy("file").agg(F.collect_set("value_kind").alias("has"))
    named = fitting.withColumn("alias", normalise_name(F.col("col"))).join(fields, ["alias", "value_kind"])
    hits = named.groupBy("file", "kind").agg(F.count_distinct(F.when(F.col("required"), F.col("field"))).alias("hits"), F.count_distinct("col").alias("used"))
    width = fitting.groupBy("file").agg(F.count_distinct("col").alias("width"))
    scored = hits.join(needed, "kind").join(present, "file").join(width, "file").filter(F.size(F.array_except("needs", "has")) == 0)
    return scored.select("file", "kind", (F.col("hits") / F.col("required_fields")).alias("required"), (F.col("used") / F.col("width")).alias("coverage"))


def identify(ranked: DataFrame) -> DataFrame:
    """The record kind of each file, where the names say it clearly enough; null where a person must."""
    order = Window.partitionBy("file").orderBy(F.desc("coverage"), F.desc("required"), "kind")
    two = ranked.withColumn("place", F.row_number().over(order)).withColumn("next_required", F.coalesce(F.lead("required").over(order), F.lit(0.0))).withColumn("next_coverage", F.coalesce(F.lead("coverage").over(order), F.lit(0.0)))
    ahead = F.struct("coverage", "required") > F.struct(F.col("next_coverage"), F.col("next_required"))
    clear = (F.col("required") >= CONFIDENT) & ahead | (F.col("required") >= ACCEPTABLE) & ahead & (F.col("required") >= F.col("next_required") * DECISIVE)
    return two.filter("place = 1").select("file", F.when(clear, F.col("kind")).alias("kind"), "required", "coverage")


def columns_of_fields(fitting: DataFrame, fields: DataFrame, placed: DataFrame) -> DataFrame:
    """For each field of a file's kind: its column if just one alias fits, open if several do, absent if none."""
    wanted = placed.filter("kind IS NOT NULL").select("file", "kind").join(fields.select("kind", "field", "required").distinct(), "kind")
    named = fitting.withColumn("alias", normalise_name(F.col("col"))).join(fields, ["alias", "value_kind"]).select("file", "kind", "field", "col").distinct()
    grouped = named.groupBy("file", "kind", "field").agg(F.count(F.lit(1)).alias("n"), F.min("col").alias("col"))
    n = F.coalesce("n", F.lit(0))
    return wanted.join(grouped, ["file", "kind", "field"], "left").select("file", "kind", "field", "required", F.when(n == 1, F.col("col")).alias("col"), F.when(n == 1, "found").when(n > 1, "open").otherwise("absent").alias("state"))


def coherent(mapping: DataFrame) -> DataFrame:
    """A mapping without the columns offered for more than one field."""
    n = F.count(F.lit(1)).over(Window.partitionBy("file", "col"))
    return mapping.withColumn("claims", n).filter("claims = 1").drop("claims")


def _identity(wide: DataFrame, withheld: bool) -> Column:
    net, whole = F.col("credit") - F.col("debit"), F.col("amount") - F.col("fee") - F.col("tax")
    if withheld:
        whole = whole - apply_rate(F.col("amount"), rate("0.0100"))
    return (net == whole) | (net == -(F.col("amount") + F.col("fee") + F.col("tax")))


def money_table(cells: DataFrame, mapping: DataFrame | dict[str, str]) -> DataFrame:
    """The five money fields of each line as paise. mapping: file, field, col; or, of a table whose columns are named, field and column."""
    if isinstance(mapping, dict):
        return cells.select("file", "line", once(*[parse_money(F.col(f"`{mapping[f]}`")).alias(f) for f in MONEY_FIELDS]))
    named = cells.join(mapping.filter(F.col("field").isin(*MONEY_FIELDS)).select("file", "field", "col"), COLUMN)
    return named.withColumn("paise", parse_money(F.col("value"))).groupBy("file", "line").pivot("field", list(MONEY_FIELDS)).agg(F.first("paise"))


def identity_check(wide: DataFrame) -> DataFrame:
    """Whether credit - debit = amount - fee - tax on every line that can be read, plain or once 1 % is withheld."""
    whole = wide.dropna(subset=list(MONEY_FIELDS))
    counts = whole.groupBy("file").agg(F.count(F.lit(1)).alias("checked"), F.count_if(~_identity(whole, False)).alias("plain"), F.count_if(~_identity(whole, True)).alias("held"))
    failed = F.least("plain", "held")
    return counts.select("file", "checked", failed.alias("failed"), (F.col("held") < F.col("plain")).alias("withheld"), ((F.col("checked") >= MINIMUM_ROWS) & (failed == 0)).alias("holds"))


def solve_money(cells: DataFrame, known: DataFrame | dict[str, str], missing: list[str]) -> DataFrame:
    """The one arrangement of unknown money columns that a file's lines accept; null columns where none or several do.

    A line's parsed cells travel together, so each arrangement is tried on the line
    and only counts are shuffled: at most 12 candidates for at most 3 unknowns.
    known: file, field, col; or field and column where all files share them.
    """
    if not 0 < len(missing) <= MOST_UNKNOWN:
        raise ValueError("one to three unknown columns")
    parsed = flat(cells).select("file", "line", "col", parse_money(F.col("value")).alias("paise")).filter("paise IS NOT NULL")
    if is_table(cells):
        money = [F.struct(F.lit(n).alias("col"), parse_money(F.col(f"`{n}`")).alias("paise")) for n in names_in(cells)]
        rows = cells.select("file", once(F.array(*money).alias("read"))).select("file", once(F.map_from_entries(F.filter("read", lambda c: c["paise"].isNotNull())).alias("paise")))
    else:
        rows = parsed.groupBy("file", "line").agg(F.map_from_entries(F.collect_list(F.struct("col", "paise"))).alias("paise"))
    readable = parsed.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MINIMUM_ROWS)
    if isinstance(known, dict):
        readable = readable.filter(~F.col("col").isin(*known.values()))
        fixed = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    else:
        readable = readable.join(known.select("file", "col"), COLUMN, "left_anti")
        fixed = known.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("field", "col"))).alias("fixed"))
    free = readable.groupBy("file").agg(F.sort_array(F.collect_list("col")).alias("free")).filter(F.size("free") <= MOST_CANDIDATES)
    free = free.withColumn("fixed", fixed) if isinstance(known, dict) else free.join(fixed, "file")
    trial = rows.join(free, "file")
    for name in missing:
        trial = trial.withColumn(f"c_{name}", F.explode("free"))
    picked = F.array(*[f"c_{name}" for name in missing])
    trial = trial.filter(F.size(F.array_distinct(picked)) == len(missing))
    for name in MONEY_FIELDS:
        column = F.col(f"c_{name}") if name in missing else F.element_at("fixed", name)
        trial = trial.withColumn(name, F.try_element_at("paise", column))
    whole = trial.dropna(subset=list(MONEY_FIELDS))
    by = ["file", *[f"c_{name}" for name in missing]]
    counts = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("checked"), F.count_if(~_identity(whole, False)).alias("plain"), F.count_if(~_identity(whole, True)).alias("held"))
    fine = counts.filter((F.least("plain", "held") == 0) & (F.col("checked") >= MINIMUM_ROWS))
    one = fine.groupBy("file").agg(F.count(F.lit(1)).alias("solutions"), *[F.first(f"c_{name}").alias(name) for name in missing])
    return one.select("file", "solutions", *[F.when(F.col("solutions") == 1, F.col(name)).alias(name) for name in missing])


def steps(cells: DataFrame) -> DataFrame:
    """Each money cell with what it moved by since the line before."""
    paise = cells.withColumn("paise", parse_money(F.col("value")))
    before = F.lag("paise").over(Window.partitionBy(*COLUMN).orderBy("line"))
    return paise.withColumn("step", F.col("paise") - before)


def counters(cells: DataFrame) -> DataFrame:
    """Columns that climb by one and the same step on every line."""
    s = steps(cells).filter("step IS NOT NULL").groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("steps"), F.min("step").alias("low"), F.max("step").alias("high"))
    return s.filter("low = high AND low <> 0").select(*COLUMN, F.col("low").alias("step"))


def running_totals(cells: DataFrame) -> DataFrame:
    """Pairs of columns (col, of) where the first accumulates the second on every readable step, twelve at least."""
    s = steps(cells).filter("paise IS NOT NULL")
    lines = s.groupBy("file", "line").agg(F.collect_list(F.struct("col", "paise", "step")).alias("cells"))
    pairs = lines.select("file", F.explode("cells").alias("a"), "cells").filter("a.step IS NOT NULL").select("file", F.col("a.col").alias("col"), F.col("a.step").alias("step"), F.explode("cells").alias("b")).filter("b.col <> col")
    grouped = pairs.groupBy("file", "col", F.col("b.col").alias("of")).agg(F.count(F.lit(1)).alias("steps"), F.bool_and(F.col("step") == F.col("b.paise")).alias("holds"))
    return grouped.filter(F.col("holds") & (F.col("steps") >= MINIMUM_ROWS)).select("file", "col", "of", "steps")


def only_deposit(cells: DataFrame, money_columns: DataFrame) -> DataFrame:
    """What remains of a statement's money columns once zeros, counters and running balances are out; the deposit if it is one."""
    own = cells.join(money_columns.select(*COLUMN), COLUMN, "left_semi")
    read = own.withColumn("paise", parse_money(F.col("value"))).groupBy(*COLUMN).agg(F.count("paise").alias("n"), F.max(F.abs("paise")).alias("most"))
    alive = read.filter((F.col("n") >= MINIMUM_ROWS) & (F.col("most") != 0)).join(counters(own), COLUMN, "left_anti").join(running_totals(own).select(*COLUMN), COLUMN, "left_anti")
    return alive.groupBy("file").agg(F.count(F.lit(1)).alias("left"), F.min("col").alias("first")).select("file", "left", F.when(F.col("left") == 1, F.col("first")).alias("deposit"))


def earliest_date(cells: DataFrame, after: DataFrame, pattern: str) -> DataFrame:
    """The one date column that never runs ahead of another and is earlier on twelve lines. after: file, col."""
    dated = cells.withColumn("moment", parse_temporal(F.col("value"), pattern).cast("date")).filter("moment IS NOT NULL")
    payout = dated.join(after.select(*COLUMN), COLUMN, "left_semi").select("file", "line", F.col("moment").alias("paid"))
    pairs = dated.join(after.select(*COLUMN), COLUMN, "left_anti").join(payout, ["file", "line"])
    checked = pairs.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("moment") > F.col("paid")).alias("ahead"), F.count_if(F.col("moment") < F.col("paid")).alias("earlier"))
    alive = checked.filter((F.col("n") >= MINIMUM_ROWS) & (F.col("ahead") == 0) & (F.col("earlier") >= MINIMUM_ROWS))
    return alive.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("col").alias("first")).select("file", F.when(F.col("n") == 1, F.col("first")).alias("col"), F.col("n").alias("candidates"))


def _only(cells: DataFrame, alive: DataFrame) -> DataFrame:
    """Cells of the columns listed (col, or file and col); of a table, other columns are not read."""
    if is_table(cells):
        names = {r["col"] for r in alive.select("col").distinct().collect()}  # the table's own at most
        kept = [n for n in names_in(cells) if n in names] or names_in(cells)[:1]
        cells = flat(cells.select("file", "line", *[F.col(f"`{n}`") for n in kept]))
    return cells.join(alive, alive.columns, "left_semi")


def contained(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Columns whose distinct values are nearly all among known ids. known: value.

    A column with no value between the first and the last known id has none of them.
    """
    span = F.broadcast(known.agg(F.min("value").alias("low"), F.max("value").alias("high")))
    alive = cut(flat(cells).crossJoin(span).filter(F.trim("value").between(F.col("low"), F.col("high"))).select(*COLUMN).distinct())
    values = _filled(_only(cells, alive)).select(*COLUMN, F.trim("value").alias("value")).distinct()
    hit = values.join(known.select("value", F.lit(1).alias("hit")).distinct(), "value", "left")
    counts = hit.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("distinct"), F.count("hit").alias("found"))
    return counts.filter((F.col("distinct") >= MINIMUM_ROWS) & (F.col("found") >= F.col("distinct") * CONTAINED))


def vocabulary_columns(cells: DataFrame) -> DataFrame:
    """Columns whose every filled value belongs to one closed list."""
    lists = {"entity_type": member_of(F.col("value"), ENTITY), "payment_method": member_of(F.col("value"), METHOD), "card_type": member_of(F.col("value"), CARD_TYPE), "boolean": parse_bool(F.col("value"))}
    seen = _filled(cells).groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("seen"), *[F.count(c).alias(k) for k, c in lists.items()])
    named = F.array_compact(F.array(*[F.when(F.col(k) == F.col("seen"), F.lit(k)) for k in lists]))
    return seen.filter(F.col("seen") >= MINIMUM_ROWS).select(*COLUMN, "seen", F.explode(named).alias("vocabulary"))


def unique_keys(cells: DataFrame) -> DataFrame:
    """Columns filled and different on every line."""
    counts = cells.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.trim("value") == "").alias("blank"), F.count_distinct(F.trim("value")).alias("distinct"))
    return counts.filter((F.col("rows") >= MINIMUM_ROWS) & (F.col("blank") == 0) & (F.col("distinct") == F.col("rows"))).select(*COLUMN, "rows")


def _grams(text: Column) -> Column:
    """Every run of QUOTED_CHARS characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - QUOTED_CHARS + 1), lambda i: F.substring(text, i, F.lit(QUOTED_CHARS))))


def quoted_values(cells: DataFrame, narrations: DataFrame) -> DataFrame:
    """How many of each column's longer values a bank quoted, anywhere in its narrations. narrations: text.

    A value is looked up by its rarest run of QUOTED_CHARS characters in an index of all
    such runs of the narrations, and then compared in full: a value one of whose runs no
    narration has is not quoted. The index is many times its texts, which Spark's
    estimate does not know, so that it is merged, never sent whole to the driver.
    """
    texts = narrations.select("text").filter(F.length("text") >= QUOTED_CHARS).distinct()
    index = texts.select("text", F.explode(_grams(F.col("text"))).alias("gram")).hint("merge")
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    values = cut(_filled(cells).select(*COLUMN, F.trim("value").alias("value")).filter(F.length("value") >= QUOTED_CHARS).distinct())
    asked = values.select("value").distinct().select("value", F.explode(_grams(F.col("value"))).alias("gram")).join(often, "gram", "left")
    rarest = asked.groupBy("value").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("least")).filter("least.often > 0").select("value", F.col("least.gram").alias("gram"))
    said = rarest.join(index, "gram").filter(F.contains("text", "value")).select("value", F.lit(1).alias("hit")).distinct()
    return values.join(said, "value", "left").groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("distinct"), F.count("hit").alias("found"))


def is_quoted(quota: float = QUOTED) -> Column:
    """Whether such counts make a column one that the bank echoes."""
    return (F.col("distinct") >= MINIMUM_ROWS) & (F.col("found") >= MINIMUM_ROWS) & (F.col("found") >= F.col("distinct") * quota)


def quoted_columns(cells: DataFrame, narrations: DataFrame, quota: float = QUOTED) -> DataFrame:
    """Columns that the bank echoes. Where no value begins with a run of some narration, none is looked up."""
    grams = narrations.select("text").filter(F.length("text") >= QUOTED_CHARS).distinct().select(F.explode(_grams(F.col("text"))).alias("gram")).distinct().hint("merge")
    value = F.trim("value")
    begins = flat(cells).filter(F.length(value) >= QUOTED_CHARS).select("col", F.substring(value, 1, QUOTED_CHARS).alias("gram")).distinct()
    # a semi join would be put below the distinct above it, and every cell be shuffled
    alive = cut(begins.join(grams, "gram").select("col").distinct())
    return quoted_values(_only(cells, alive), narrations).filter(is_quoted(quota))


def _with(cells: DataFrame, against: DataFrame | str, name: str) -> DataFrame:
    """Cells (file, col, own), each with the value of another column of its line. against: file, col; or a column of a table."""
    if isinstance(against, str):
        others = cells.select("file", F.col(f"`{against}`").alias(name), stacked([n for n in names_in(cells) if n != against]))
    elif is_table(cells):
        names = names_in(cells)
        theirs = against.select(*COLUMN).filter(F.col("col").isin(names)).groupBy("file").agg(F.collect_set("col").alias("_cols"))
        met = cells.join(theirs, "file").withColumn("_of", F.explode("_cols"))
        value = F.coalesce(*[F.when(F.col("_of") == n, F.col(f"`{n}`")) for n in names])
        others = met.select("file", "_cols", value.alias(name), stacked(names)).filter(~F.array_contains("_cols", F.col("col")))
    else:
        cells = flat(cells)
        one = cells.join(against.select(*COLUMN), COLUMN, "left_semi").select("file", "line", F.col("value").alias(name))
        others = cells.join(against.select(*COLUMN), COLUMN, "left_anti").join(one, ["file", "line"])
    return others.select(*COLUMN, F.trim("value").alias("own"), F.trim(name).alias(name))


def paired_columns(cells: DataFrame, against: DataFrame | str) -> DataFrame:
    """Columns in one-to-one correspondence with another, in groups. against: file, col; or a column of a table.

    Where values with one partner differ in their hashes, a column is out; only what
    is left, of which there is little, is grouped by its values.
    """
    pairs = _with(cells, against, "other")
    own = F.xxhash64("own")
    by_other = pairs.groupBy(*COLUMN, "other").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.count_if((F.col("own") == "") != (F.col("other") == "")).alias("uneven"))
    out = F.bool_or((F.col("uneven") > 0) | ((F.col("other") != "") & (F.col("low") != F.col("high"))))
    alive = cut(by_other.groupBy(*COLUMN).agg(out.alias("out")).filter("NOT out").select(*COLUMN))
    kept = _with(cells, against, "other").join(alive, COLUMN, "left_semi")
    both = kept.filter("own <> '' AND other <> ''").groupBy(*COLUMN, "own", "other").agg(F.count(F.lit(1)).alias("n"))
    counts = both.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("own").alias("owns"), F.count_distinct("other").alias("others"), F.sum("n").alias("rows"))
    fine = counts.filter("pairs = owns AND pairs = others AND pairs > 1 AND pairs < rows")
    return fine.filter(F.col("rows") >= MINIMUM_ROWS).select(*COLUMN, F.col("pairs").alias("groups"), "rows")


def flag_columns(cells: DataFrame, filled: DataFrame | str) -> DataFrame:
    """Yes/no columns that are true on exactly the lines where another column is filled. filled: file, col; or a column of a table."""
    flags = _with(cells, filled, "there").select(*COLUMN, parse_bool(F.col("own")).alias("flag"), (F.col("there") != "").alias("there"))
    counts = flags.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("rows"), F.count("flag").alias("read"), (F.min("flag") != F.max("flag")).alias("both"), F.count_if(F.col("flag") == F.col("there")).alias("agreed"))
    return counts.filter((F.col("rows") >= MINIMUM_ROWS) & (F.col("read") == F.col("rows")) & F.col("both") & (F.col("agreed") == F.col("rows"))).select(*COLUMN, "rows")


def limitations(mapped: DataFrame, placed: DataFrame, kinds: list[str]) -> DataFrame:
    """What an import cannot do: kinds nobody supplied, and fields that a file lacks. mapped: columns_of_fields."""
    spark = placed.sparkSession
    wanted = spark.createDataFrame([(k,) for k in kinds], "kind string")
    none = wanted.join(placed.select("kind").distinct(), "kind", "left_anti").select(F.lit(None).cast("string").alias("file"), "kind", F.lit(None).cast("string").alias("field"), F.col("kind").isin("settlement_rows", "bank_credits").alias("blocking"))
    lacking = mapped.filter("state <> 'found'").select("file", "kind", "field", (F.col("required") & (F.col("state") != "found")).alias("blocking"))
    return none.unionByName(lacking)


def has_card_types(rows: DataFrame) -> DataFrame:
    """Whether any row of a merchant carries a card type."""
    return rows.groupBy("merchant_id").agg(F.max(F.col("card_type").isNotNull()).alias("has_card_types"))


def settle_from_folder(cells: DataFrame, placed: DataFrame, payment_ids: DataFrame, order_ids: DataFrame, narrations: DataFrame) -> DataFrame:
    """Fields of report files found by what other files and their own values say, in a fixed order; a column once taken stays taken.

    cells: cells or a table of the files' lines; they are made once for all fields.
    """
    report = cut(cells.join(cut(placed.filter("kind = 'settlement_rows'").select("file")), "file", "left_semi"))
    taken, out = None, None

    def take(found: DataFrame, field: str) -> None:
        nonlocal taken, out
        if taken is not None:
            found = found.join(taken, COLUMN, "left_anti")
        alone = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file"))).filter("n = 1").select(*COLUMN, F.lit(field).alias("field"))
        alone = cut(alone)
        out = alone if out is None else out.unionByName(alone)
        taken = out.select(*COLUMN)

    lists = cut(vocabulary_columns(flat(report)))
    take(lists.filter("vocabulary = 'entity_type'"), "type")
    take(lists.filter("vocabulary = 'payment_method'"), "method")
    take(lists.filter("vocabulary = 'card_type'"), "card_type")
    take(contained(report, payment_ids), "payment_id")
    take(contained(report, order_ids), "order_id")
    take(quoted_columns(report, narrations), "settlement_utr")
    take(paired_columns(report, out.filter("field = 'settlement_utr'")), "settlement_id")
    take(flag_columns(report, out.filter("field = 'settlement_id'")), "settled")
    take(unique_keys(flat(report).join(taken, COLUMN, "left_anti")), "entity_id")
    take(lists.filter("vocabulary = 'boolean'"), "on_hold")
    return out

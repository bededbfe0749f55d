"""Duplicate columns and tables: synonym groups, fuzzy pairs, table similarity, consolidation SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.lineage import cut

#: Least similarity of fuzzy pairs and of tables; weights of the columns' and the names' similarity. Fixed values.
FUZZY, TABLES, JACCARD_WEIGHT, NAME_WEIGHT = 0.75, 0.6, 0.7, 0.3


def synonym_groups(columns: DataFrame) -> DataFrame:
    """schema_id, meaning, canonical, table_name, column_name, data_type of groups of two columns or more."""
    known = names.synonyms(columns.sparkSession)
    hits = columns.withColumn("synonym", names.normal(F.col("column_name"))).join(F.broadcast(known), "synonym")  # the fixed list above
    size = F.count(F.lit(1)).over(Window.partitionBy("schema_id", "meaning"))
    return hits.withColumn("members", size).where("members >= 2").select("schema_id", "meaning", "canonical", "table_name", "column_name", "data_type", "members")


def fuzzy_pairs(values: DataFrame, name: str, key: list[str] | None = None, least: float = FUZZY) -> DataFrame:
    """a, b, sim of distinct names a < b with least <= sim < 1; least is 0.75 or more.

    d edits change at most 2 d of a name's pairs of neighbouring letters (the second occurrence of a pair counts as another one),
    so names that are alike share most. A name is looked up by its rarest pairs only, so many that a partner must have one of
    them (prefix filter): a row for about every second letter, and no comparing of all names.
    """
    if least < FUZZY:
        raise ValueError(f"least is {FUZZY} or more")
    key = key or []
    rows = values.select(*key, F.lower(name).alias("v")).where("v is not null and v != ''").distinct().withColumn("len", F.length("v"))
    grams = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.col("len") - 1, F.lit(1))))).select(*key, "v", "len", "i", F.substr("v", F.col("i"), F.lit(2)).alias("g"))
    again = F.row_number().over(Window.partitionBy(*key, "v", "g").orderBy("i"))
    grams = grams.select(*key, "v", "len", F.concat_ws("#", "g", again.cast("string")).alias("g"))
    common = grams.groupBy(*key, "g").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # pairs shared with a partner of the longer length m at least: m - 1 - 2 * floor((1 - least) * m)
    longest = F.floor(F.col("len") / least + 1e-9).cast("int")
    need = F.array_min(F.transform(F.sequence(F.col("len"), longest), lambda m: m - 1 - 2 * F.floor(m * (1 - least) + 1e-9)))
    own = Window.partitionBy(*key, "v")
    ranked = grams.join(common, [*key, "g"]).withColumn("need", F.greatest(need, F.lit(1))).withColumn("has", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("c", "g")))
    held = ranked.where("rank <= has - need + 1").select(*key, "g", "v", "len")
    found = held.toDF(*key, "g", "a", "la").join(held.toDF(*key, "g", "b", "lb"), [*key, "g"]).where((F.col("a") < F.col("b")) & (F.least("la", "lb") >= least * F.greatest("la", "lb"))).select(*key, "a", "b").distinct()
    return found.withColumn("sim", names.similarity(F.col("a"), F.col("b"))).where(F.col("sim") >= least)


def first_groups(pairs: DataFrame) -> DataFrame:
    """schema_id, pos, head of every column in pairs (schema_id, pos_a, pos_b; pos_a < pos_b): the first group that has it.

    Pairs are taken by (pos_a, pos_b), and each joins the first group that has its first column, or makes a new one. So a column
    without a pair before it heads a group, and others are first in the least group of those they follow: the least head that is
    reached by going back. Labels are lowered along pairs, and by what the label's own column has, until none changes.
    """
    ends = pairs.select("schema_id", F.explode(F.array("pos_a", "pos_b")).alias("pos")).distinct()
    follows = pairs.groupBy("schema_id", F.col("pos_b").alias("pos")).agg(F.min("pos_a").alias("back"))
    edges = cut(pairs.select("schema_id", "pos_a", F.col("pos_b").alias("pos")))
    labels = cut(ends.join(follows, ["schema_id", "pos"], "left").select("schema_id", "pos", F.coalesce("back", "pos").alias("head")))
    while True:
        over = edges.join(labels.select("schema_id", F.col("pos").alias("pos_a"), F.col("head").alias("near")), ["schema_id", "pos_a"]).groupBy("schema_id", "pos").agg(F.min("near").alias("near"))
        beyond = labels.select("schema_id", F.col("pos").alias("head"), F.col("head").alias("beyond"))
        lower = labels.join(over, ["schema_id", "pos"], "left").join(beyond, ["schema_id", "head"], "left")
        lower = cut(lower.select("schema_id", "pos", F.least("head", F.coalesce("near", "head"), F.coalesce("beyond", "head")).alias("head"), F.col("head").alias("was")))
        if lower.where("head != was").isEmpty():
            return lower.select("schema_id", "pos", "head")
        labels = lower.drop("was")


def fuzzy_groups(columns: DataFrame, least: float = FUZZY) -> DataFrame:
    """schema_id, group_no, meaning, suggestion, member_no, table_name, column_name, data_type, reason: pairs in (table, column)
    order, each joining the first group that has its first column. A column that joins a group twice is listed twice. Of two pairs
    with the same two tables and the same two names the first counts.
    """
    pairs = fuzzy_pairs(columns, "column_name", ["schema_id"], least)
    both = pairs.select("schema_id", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "sim"), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "sim"))).alias("p")).select("schema_id", "p.*")
    own = columns.withColumn("pos", F.row_number().over(Window.partitionBy("schema_id").orderBy("table_name", "ordinal")))
    side = lambda k, c: own.select("schema_id", F.lower("column_name").alias(c), F.col("table_name").alias(f"table_{k}"), F.col("column_name").alias(f"column_{k}"), F.col("data_type").alias(f"type_{k}"), F.col("pos").alias(f"pos_{k}"))
    ordered = both.join(side("a", "x"), ["schema_id", "x"]).join(side("b", "y"), ["schema_id", "y"]).where("pos_a < pos_b")
    same = F.array_sort(F.array("table_a", "column_a", "table_b", "column_b"))
    once = ordered.withColumn("nth", F.row_number().over(Window.partitionBy("schema_id", same).orderBy("pos_a", "pos_b"))).where("nth = 1").drop("nth", "x", "y")
    once = cut(once)
    grouped = once.join(first_groups(once).withColumnRenamed("pos", "pos_a"), ["schema_id", "pos_a"])
    why = lambda k: F.concat(F.lit('like "'), F.col(f"table_{k}"), F.lit("."), F.col(f"column_{k}"), F.lit('" ('), F.floor(F.col("sim") * 100 + 0.5).cast("string"), F.lit("%)"))
    member = lambda at, k, reason: F.struct(at.alias("at"), F.col(f"table_{k}").alias("table_name"), F.col(f"column_{k}").alias("column_name"), F.col(f"type_{k}").alias("data_type"), reason.alias("reason"))
    second = member(F.struct("pos_a", "pos_b"), "b", why("a"))
    # a group begins with the first pair of its head, which stands before its partner
    heads = Window.partitionBy("schema_id", "head").orderBy("pos_a", "pos_b")
    first = F.row_number().over(heads) == 1
    rows = grouped.withColumn("first", first).withColumn("ms", F.when(F.col("first"), F.array(member(F.struct("pos_a", F.lit(-1).alias("pos_b")), "a", why("b")), second)).otherwise(F.array(second)))
    begun = rows.where("first").select("schema_id", "head", (F.row_number().over(Window.partitionBy("schema_id").orderBy("head")) - 1).alias("group_no"), F.concat("column_a", F.lit(" ~ "), "column_b").alias("meaning"), F.concat(F.lit('give "'), "column_a", F.lit('" and "'), "column_b", F.lit('" one name')).alias("suggestion"))
    listed = rows.select("schema_id", "head", F.explode("ms").alias("m")).withColumn("member_no", F.row_number().over(Window.partitionBy("schema_id", "head").orderBy("m.at")) - 1)
    return listed.join(begun, ["schema_id", "head"]).select("schema_id", "group_no", "meaning", "suggestion", "member_no", "m.table_name", "m.column_name", "m.data_type", "m.reason")


def jaccard_pairs(items: DataFrame, group: str, item: str, least: float, within: list[str] | None = None) -> DataFrame:
    """a, b, jaccard of groups a < b (of the same ``within`` columns, if given) that are alike by ``least`` or more, least > 0.

    Groups are looked up by their rarest items only, so many that a partner must have one of them (prefix filter): an item that
    all groups have makes no pairs. Pairs whose numbers of items are too different are never formed.
    """
    if not 0 < least <= 1:
        raise ValueError("least is over 0 and at most 1")
    key = within or []
    rows = items.select(*key, F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    sets = rows.groupBy(*key, "g").agg(F.collect_set("i").alias("s"))
    counts = rows.groupBy(*key, "i").agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy(*key, "g")
    ranked = rows.join(counts, [*key, "i"]).withColumn("n", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("c", "i")))
    rows = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select(*key, "g", "i", "n")
    met = rows.toDF(*key, "a", "i", "na").join(rows.toDF(*key, "b", "i", "nb"), [*key, "i"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)).select(*key, "a", "b").distinct()
    both = met.join(sets.toDF(*key, "a", "sa"), [*key, "a"]).join(sets.toDF(*key, "b", "sb"), [*key, "b"]).withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return both.select(*key, "a", "b", (F.col("both") / (F.size("sa") + F.size("sb") - F.col("both"))).alias("jaccard")).where(F.col("jaccard") >= least - 1e-9)


def table_pairs(columns: DataFrame, least: float = TABLES) -> DataFrame:
    """schema_id, a, b, columns_a, columns_b, jaccard, name_sim, combined, suggestion of similar tables of one schema, the most
    alike first.

    Names alone can't reach ``least``, so pairs share columns: at least the part that is missing when names are equal.
    """
    named = columns.select("schema_id", "table_name", names.normal(F.col("column_name")).alias("c"))
    sizes = columns.groupBy("schema_id", "table_name").agg(F.count(F.lit(1)).alias("n"))
    found = jaccard_pairs(named, "table_name", "c", (least - NAME_WEIGHT) / JACCARD_WEIGHT, ["schema_id"]).withColumn("name_sim", names.similarity(names.normal(F.col("a")), names.normal(F.col("b"))))
    found = found.withColumn("combined", JACCARD_WEIGHT * F.col("jaccard") + NAME_WEIGHT * F.col("name_sim")).where(F.col("combined") >= least)
    text = F.concat(F.lit('tables "'), "a", F.lit('" and "'), "b", F.lit('" are alike by '), F.floor(F.col("combined") * 100 + 0.5).cast("string"), F.lit("%"))
    out = found.join(sizes.toDF("schema_id", "a", "columns_a"), ["schema_id", "a"]).join(sizes.toDF("schema_id", "b", "columns_b"), ["schema_id", "b"])
    return out.select("schema_id", "a", "b", "columns_a", "columns_b", "jaccard", "name_sim", "combined", text.alias("suggestion")).orderBy("schema_id", F.desc("combined"), "a", "b")


def duplicate_groups(columns: DataFrame) -> DataFrame:
    """schema_id, meaning, suggestion, members (table.column of each), n: groups by meaning, then fuzzy ones; the largest first,
    of equal ones those by meaning first, then in the order they were found."""
    known = synonym_groups(columns)
    place = F.row_number().over(Window.partitionBy("schema_id").orderBy("table_name", "ordinal"))
    rows = known.join(columns.withColumn("pos", place).select("schema_id", "table_name", "column_name", "pos"), ["schema_id", "table_name", "column_name"])
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(".", "table_name", "column_name").alias("c")))), lambda s: s["c"])
    order = F.array_position(F.array(*map(F.lit, names.SYNONYMS)), F.col("meaning"))
    by_meaning = rows.groupBy("schema_id", "meaning", "canonical").agg(listed.alias("members"))
    by_meaning = by_meaning.select("schema_id", "meaning", F.concat(F.lit('name all "'), "canonical", F.lit('": ['), F.array_join("members", ", "), F.lit("]")).alias("suggestion"), "members", F.lit(0).alias("kind"), order.cast("int").alias("at"))
    fuzzy = fuzzy_groups(columns).groupBy("schema_id", "group_no", "meaning", "suggestion").agg(F.transform(F.sort_array(F.collect_list(F.struct("member_no", F.concat_ws(".", "table_name", "column_name").alias("c")))), lambda s: s["c"]).alias("members"))
    both = by_meaning.unionByName(fuzzy.select("schema_id", "meaning", "suggestion", "members", F.lit(1).alias("kind"), F.col("group_no").alias("at")))
    return both.withColumn("n", F.size("members")).orderBy("schema_id", F.desc("n"), "kind", "at").select("schema_id", "meaning", "suggestion", "members", "n")


def consolidation_sql(groups: DataFrame) -> DataFrame:
    """schema_id, meaning, id, up_sql, down_sql, tables, risk_level of groups (rows schema_id, meaning, canonical, table_name,
    column_name, data_type): a script for each schema and meaning."""
    w = Window.partitionBy("schema_id", "meaning", "table_name")
    t, c, k, q = F.col("table_name"), F.col("column_name"), F.col("canonical"), names.quoted
    rows = groups.withColumn("winner", F.min_by("column_name", F.struct((c != k).alias("o"), "column_name")).over(w)).withColumn("wins", c == F.col("winner"))
    alter = F.concat(F.lit("ALTER TABLE "), q(t))
    up = F.when(F.col("wins"), F.when(c != k, F.concat(alter, F.lit(" RENAME COLUMN "), q(c), F.lit(" TO "), q(k), F.lit(";")))).otherwise(
        F.concat(F.lit("UPDATE "), q(t), F.lit(" SET "), q(k), F.lit(" = COALESCE("), q(k), F.lit(", "), q(c), F.lit(");\n"), alter, F.lit(" DROP COLUMN "), q(c), F.lit(";"))
    )
    down = F.when(F.col("wins"), F.when(c != k, F.concat(alter, F.lit(" RENAME COLUMN "), q(k), F.lit(" TO "), q(c), F.lit(";")))).otherwise(F.concat(alter, F.lit(" ADD COLUMN "), q(c), F.lit(" "), F.col("data_type"), F.lit(";")))
    order = F.struct("table_name", (~F.col("wins")).alias("o"), "column_name", up.alias("up"), down.alias("down"))
    listed = rows.groupBy("schema_id", "meaning", "canonical").agg(F.sort_array(F.collect_list(order)).alias("s"), F.countDistinct("table_name").alias("n"))
    text = lambda xs, f: F.array_join(F.array_compact(F.transform(xs, lambda s: s[f])), "\n")
    return listed.select("schema_id", "meaning", F.concat(F.lit("consolidate_"), "meaning", F.lit("_"), F.substring(F.sha2(text(F.col("s"), "up"), 256), 1, 8)).alias("id"), text(F.col("s"), "up").alias("up_sql"), text(F.reverse("s"), "down").alias("down_sql"), F.col("n").alias("tables"), F.when(F.col("n") > 1, "high").otherwise("medium").alias("risk_level"))

"""Table lineage from object dependencies, query history and DDL history.

Nodes and edges are DataFrames.  Source tables are found in query text by a small lexer, a fold in
column expressions: every item of the list after a FROM or JOIN, up to the next clause, gives its
name; a subquery is read at its own FROM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Statement types, words that are no tables, the slow-query bound.
MODIFYING = ["INSERT", "UPDATE", "MERGE", "CREATE_TABLE_AS_SELECT", "CREATE_TABLE"]
TRANSFORMING = ["CREATE_TABLE_AS_SELECT", "INSERT", "MERGE"]
EVENT_TRANSFORMS = ["INSERT", "UPDATE", "MERGE", "CREATE_TABLE_AS_SELECT", "DELETE"]
KEYWORDS = ["SELECT", "DISTINCT", "TOP", "ALL"]
SLOW_MS = 10000
PAIR_ROWS = 1000  # transformations up to which nodes may be numbered or paired with every source
CLAUSES = "WHERE|GROUP|ORDER|HAVING|LIMIT|QUALIFY|WINDOW|UNION|INTERSECT|EXCEPT|ON|USING|WHEN"


def _same(column: str, text: str) -> Column:
    return F.upper(F.col(column)) == text.upper()


def object_dependencies(deps: DataFrame, database: str, schema: str, table: str) -> DataFrame:
    """Dependencies that touch the table on either side and end in a table."""
    def side(p: str) -> Column:
        return _same(f"{p}_DATABASE", database) & _same(f"{p}_SCHEMA", schema) & _same(f"{p}_TABLE", table)

    return deps.where((side("SOURCE") | side("TARGET")) & (F.col("TARGET_TYPE") == "TABLE"))


def _contains(*parts: str) -> Column:
    """Upper-cased query text holds the parts in this order."""
    pattern = "%" + "%".join(p.upper().replace("\\", "\\\\").replace("_", "\\_") for p in parts) + "%"
    return F.upper(F.col("QUERY_TEXT")).like(pattern)


def _recent(column: str, days: int, as_of) -> Column:
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return F.col(column) >= now - F.make_interval(days=F.lit(days))


def newest(df: DataFrame, time_column: str, limit: int | None, *ties: str) -> DataFrame:
    """Newest rows first; ``limit`` is the report's top k, None keeps everything."""
    if limit is None:
        return df
    return df.orderBy(F.desc(time_column), *ties).limit(limit)


def table_queries(history: DataFrame, database: str, schema: str, table: str, as_of=None,
                  limit: int | None = None) -> DataFrame:
    """Successful queries of 90 days that create or modify the table, or slow reads of it."""
    kind = F.col("QUERY_TYPE")
    touches = (_contains("INTO", table) | _contains("UPDATE", table) | _contains("TABLE", table)
               | _contains(f"{database}.{schema}.{table}"))
    wanted = ((kind.isin(MODIFYING) & touches)
              | ((kind == "SELECT") & (F.col("TOTAL_ELAPSED_TIME") > SLOW_MS) & _contains("FROM", table)))
    found = history.where(_recent("QUERY_START_TIME", 90, as_of) & (F.col("EXECUTION_STATUS") == "SUCCESS") & wanted)
    return newest(found.withColumn("SOURCE_VIEW", F.lit("QUERY_HISTORY")), "QUERY_START_TIME", limit, "QUERY_ID")


def table_queries_simple(history: DataFrame, table: str, as_of=None, limit: int | None = None) -> DataFrame:
    """Fallback: any successful query of 30 days that names the table."""
    kinds = ["INSERT", "UPDATE", "CREATE_TABLE_AS_SELECT", "SELECT", "MERGE"]
    found = history.where(_recent("QUERY_START_TIME", 30, as_of) & (F.col("EXECUTION_STATUS") == "SUCCESS")
                          & _contains(table) & F.col("QUERY_TYPE").isin(kinds))
    return newest(found.withColumn("SOURCE_VIEW", F.lit("QUERY_HISTORY_SIMPLE")), "QUERY_START_TIME", limit, "QUERY_ID")


def ddl_history(ddl: DataFrame, database: str, schema: str, table: str, as_of=None,
                limit: int | None = None) -> DataFrame:
    """CREATE, ALTER and DROP of the table in 90 days."""
    found = ddl.where(_same("DATABASE_NAME", database) & _same("SCHEMA_NAME", schema) & _same("OBJECT_NAME", table)
                      & _recent("EXECUTION_TIME", 90, as_of) & F.col("DDL_ACTION").isin("CREATE", "ALTER", "DROP")
                      & (F.col("OBJECT_TYPE") == "TABLE"))
    return newest(found.withColumn("SOURCE_VIEW", F.lit("DDL_HISTORY")), "EXECUTION_TIME", limit, "QUERY_ID")


def ddl_from_queries(history: DataFrame, database: str, schema: str, table: str, as_of=None,
                     limit: int | None = None) -> DataFrame:
    """DDL rows classified from query text, where no DDL history exists."""
    verbs = ("CREATE", "ALTER", "DROP")
    action = F.coalesce(*[F.when(_contains(v, "TABLE"), v) for v in verbs], F.lit("UNKNOWN"))
    named = _contains("CREATE", "TABLE", table) | _contains("ALTER", "TABLE", table) | _contains("DROP", "TABLE", table)
    found = history.where(_recent("QUERY_START_TIME", 90, as_of) & named
                          & F.col("QUERY_TYPE").isin("CREATE_TABLE", "ALTER", "DROP")
                          & (F.col("EXECUTION_STATUS") == "SUCCESS"))
    shaped = found.select(
        "QUERY_ID", "QUERY_TEXT", F.lit(database).alias("DATABASE_NAME"), F.lit(schema).alias("SCHEMA_NAME"),
        F.lit(table).alias("OBJECT_NAME"), F.lit("TABLE").alias("OBJECT_TYPE"), action.alias("DDL_ACTION"),
        F.col("USER_NAME").alias("EXECUTED_BY"), F.col("QUERY_START_TIME").alias("EXECUTION_TIME"),
        F.lit("QUERY_HISTORY_DDL").alias("SOURCE_VIEW"))
    return newest(shaped, "EXECUTION_TIME", limit, "QUERY_ID")


def combine(deps: DataFrame, queries: DataFrame, ddl: DataFrame) -> DataFrame:
    """The three shapes in one table; absent columns are NULL."""
    return deps.unionByName(queries, allowMissingColumns=True).unionByName(ddl, allowMissingColumns=True)


# what the lexer sees: comments and literals become blanks, names keep their dots and quotes
NOISE = r"""--[^\n]*|/\*(?s:.*?)(?:\*/|\z)|'[^'\\]*(?:\\(?s:.)[^'\\]*)*'?|("[^"]*"?)"""
NAME = r'''(?:"[^"]*"|[\w$@]+)'''
TOKEN = rf"{NAME}(?:\.{NAME})*|[(),;]"
CTE = "#"  # in front of a bracket's head: the name that the bracket's query defines


def _read_token() -> str:
    """How a token t changes the lexer's state s, as the merge function of a fold.

    ``kinds`` and ``modes`` hold a letter for every open bracket, the statement first: Q a query, J a bracket
    in the place of a table, ? not known yet, F anything else; E a table comes next, L after one in a list,
    N neither.  ``heads`` are the words before the open brackets.
    """
    kind, mode = "right(s.kinds, 1)", "right(s.modes, 1)"
    words = ", ".join(f"'{w}'" for w in [*CLAUSES.split("|"), *KEYWORDS, "SET", "VALUES", "WITH", ";"])
    head = "try_element_at(s.heads, -1)"

    def last(field: str, letter: str) -> str:
        return f"concat(left(s.{field}, length(s.{field}) - 1), {letter})"

    closes = "t = ')' AND size(s.heads) > 0"
    wants = f"{mode} = 'E' AND t NOT IN ('(', ')', ',', 'LATERAL', 'ONLY', 'FROM', 'JOIN', {words})"
    fields = {
        "kinds": f"""CASE WHEN t = '(' THEN concat(s.kinds, CASE WHEN {mode} = 'E' THEN 'J' ELSE '?' END)
            WHEN {closes} THEN left(s.kinds, length(s.kinds) - 1)
            WHEN t IN ('SELECT', 'WITH') AND {kind} IN ('?', 'J') THEN {last('kinds', "'Q'")}
            WHEN {kind} = '?' THEN {last('kinds', "'F'")} ELSE s.kinds END""",
        "modes": f"""CASE WHEN t = '(' THEN concat({last('modes', f"if({mode} = 'E', 'L', {mode})")}, if({mode} = 'E', 'E', 'N'))
            WHEN {closes} THEN left(s.modes, length(s.modes) - 1)
            WHEN (t = 'JOIN' OR t = 'FROM' AND s.prev != 'DISTINCT') AND {kind} IN ('Q', 'J') THEN {last('modes', "'E'")}
            WHEN t = ',' AND {mode} = 'L' THEN {last('modes', "'E'")}
            WHEN t IN ({words}) THEN {last('modes', "'N'")}
            WHEN {wants} THEN {last('modes', "'L'")} ELSE s.modes END""",
        "heads": f"""CASE WHEN t = '(' THEN array_append(s.heads, if(s.prev = 'AS' AND s.has_with, concat('{CTE}', s.named), s.prev))
            WHEN {closes} THEN slice(s.heads, 1, size(s.heads) - 1) ELSE s.heads END""",
        "prev": f"CASE WHEN {closes} THEN if(left({head}, 1) = '{CTE}', substr({head}, 2), {head}) WHEN s.prev = 'AS' AND t IN ('NOT', 'MATERIALIZED') THEN s.prev ELSE t END",
        "named": "if(t = 'AS', replace(s.prev, '\"', ''), s.named)",
        "has_with": "s.has_with OR t = 'WITH'",
        "recursive": "s.recursive OR t = 'RECURSIVE'",
        "ctes": f"""CASE WHEN {closes} AND left({head}, 1) = '{CTE}' THEN array_append(s.ctes, substr({head}, 2))
            WHEN t = '(' AND s.prev = 'AS' AND s.recursive THEN array_append(s.ctes, s.named) ELSE s.ctes END""",
        "pending": f"CASE WHEN {wants} THEN replace(t, '\"', '') END",
        "found": "if(s.pending IS NOT NULL AND t != '(' AND NOT array_contains(s.ctes, s.pending), array_append(s.found, s.pending), s.found)",
    }
    return "(s, t) -> named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def named_tables(text: Column) -> Column:
    """The tables that query text reads, as written there in upper case: every item of a list after FROM, and after JOIN.

    Comments and literals are no text; a FROM counts only in a query's own brackets (not in ``EXTRACT(YEAR FROM t)``
    or ``IS DISTINCT FROM``); a table function is no table, and neither is the name of a WITH query from the end
    of its body on (from its beginning after RECURSIVE).
    """
    plain = F.regexp_replace(F.regexp_replace(text, NOISE, " $1 "), r"\s*\.\s*", ".")
    tokens = F.concat(F.regexp_extract_all(F.upper(plain), F.lit(TOKEN), F.lit(0)), F.array(F.lit(";")))
    none = "CAST(array() AS ARRAY<STRING>)"
    start = (f"named_struct('kinds', 'Q', 'modes', 'N', 'heads', {none}, 'prev', '', 'named', '', 'has_with', false, 'recursive', false, "
             f"'ctes', {none}, 'pending', CAST(NULL AS STRING), 'found', {none})")
    return F.call_function("aggregate", tokens, F.expr(start), F.expr(_read_token()))["found"]


def source_tables(text: Column, database: str, schema: str, table: str, first_only: bool = False) -> Column:
    """Source tables named in query text, in order of appearance, without repeats: those of ``named_tables``, qualified.

    ``first_only`` reads by words alone: after each FROM, cut also inside longer names, only the first
    acceptable of the first three words.
    """
    center = f"{database}.{schema}.{table}"

    def named(word: Column) -> Column:
        bare = F.regexp_replace(word, "[\"';]", "")
        return F.when(bare.contains("."), F.when(F.length(bare) > 3, bare)).otherwise(F.when(
            (F.length(bare) > 2) & ~bare.rlike("^[0-9]+$"), F.concat(F.lit(f"{database}.{schema}."), bare)))

    def words(part: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(part, r"[,()]", " "), r"\s+"), lambda w: w != "")

    def first_table(part: Column) -> Column:
        cut = F.regexp_replace(part, "(?s)(?:WHERE|GROUP|ORDER|JOIN).*$", "")
        wanted = F.transform(F.filter(F.slice(words(cut), 1, 3), lambda w: ~w.isin(KEYWORDS)), named)
        return F.slice(F.filter(wanted, lambda w: w.isNotNull() & (w != center)), 1, 1)

    if first_only:
        parts = F.split(F.upper(text), "FROM")
        parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.array_distinct(F.flatten(F.transform(parts, first_table)))
    every = F.transform(named_tables(text), named)
    return F.array_distinct(F.filter(every, lambda w: w.isNotNull() & (w != center)))


def _few(rows: DataFrame) -> None:
    """Refuse a history that a numbered or paired report cannot hold; give the history a limit first."""
    if rows.limit(PAIR_ROWS + 1).count() > PAIR_ROWS:
        raise ValueError(f"more than {PAIR_ROWS} transformations: limit the history for numbered nodes or all pairs")


def _node(queries: DataFrame, numbered: bool) -> DataFrame:
    """Queries that change the table with their node id.

    ``numbered`` ids count in time order, newest first, and suit a limited history (a top-k
    report); the default names the node after the query and needs no global order.
    """
    kind = F.col("QUERY_TYPE")
    changed = queries.where(kind.isin(*TRANSFORMING, "UPDATE"))
    if numbered:
        _few(changed)
    mark = F.row_number().over(W.orderBy(F.desc("QUERY_START_TIME"), "QUERY_ID")).cast("string") if numbered \
        else F.col("QUERY_ID")
    return changed.withColumn("node", F.concat(kind, F.lit("_"), mark))


def source_edges(queries: DataFrame, database: str, schema: str, table: str, all_pairs: bool = False,
                 numbered: bool = False, **text) -> DataFrame:
    """Edges from source tables to the transformations that read them.

    ``all_pairs`` joins every source to every transformation; longer histories are refused.
    """
    nodes = _node(queries, numbered).where(F.col("QUERY_TYPE").isin(TRANSFORMING))
    found = nodes.select("node", F.explode(source_tables(
        F.col("QUERY_TEXT"), database, schema, table, **text)).alias("source"))
    if all_pairs:
        _few(nodes)
        found = found.select("source").distinct().crossJoin(nodes.select("node"))
    return found.select("source", F.col("node").alias("target"), F.lit("feeds_into").alias("relationship")).distinct()


def lineage_edges(lineage: DataFrame, database: str, schema: str, table: str, all_pairs: bool = False,
                  numbered: bool = False, **text) -> DataFrame:
    """All distinct edges: source, target, relationship."""
    center = F.lit(f"{database}.{schema}.{table}")
    queries = lineage.where(F.col("SOURCE_VIEW").contains("QUERY_HISTORY"))
    nodes = _node(queries, numbered)
    edge = lambda s, t, r: F.struct(s.alias("source"), t.alias("target"), r.alias("relationship"))
    is_update = F.col("QUERY_TYPE") == "UPDATE"
    own = nodes.select(F.inline(F.when(is_update, F.array(
        edge(center, F.col("node"), F.lit("self_update")), edge(F.col("node"), center, F.lit("updated")))
    ).otherwise(F.array(edge(F.col("node"), center, F.lower("QUERY_TYPE"))))))
    deps = lineage.where(F.col("SOURCE_VIEW") == "OBJECT_DEPENDENCIES").select(
        F.concat_ws(".", "SOURCE_DATABASE", "SOURCE_SCHEMA", "SOURCE_TABLE").alias("source"),
        F.concat_ws(".", "TARGET_DATABASE", "TARGET_SCHEMA", "TARGET_TABLE").alias("target"),
        F.lit("dependency").alias("relationship"))
    feeds = source_edges(queries, database, schema, table, all_pairs, numbered, **text)
    return own.unionByName(feeds).unionByName(deps).distinct()


def lineage_nodes(lineage: DataFrame, database: str, schema: str, table: str, numbered: bool = False,
                  **text) -> DataFrame:
    """All nodes: node, node_type, query_type, timestamp, user; a name keeps its first role."""
    center = f"{database}.{schema}.{table}"
    queries = lineage.where(F.col("SOURCE_VIEW").contains("QUERY_HISTORY"))
    changed = _node(queries, numbered).select(
        "node", F.when(F.col("QUERY_TYPE") == "UPDATE", "update").otherwise("transformation").alias("node_type"),
        F.col("QUERY_TYPE").alias("query_type"), F.col("QUERY_START_TIME").cast("string").alias("timestamp"),
        F.col("USER_NAME").alias("user"), F.lit(1).alias("role"))

    def plain(df: DataFrame, role: int) -> DataFrame:
        none = F.lit(None).cast("string")
        return df.select("node", "node_type", none.alias("query_type"), none.alias("timestamp"),
                         none.alias("user"), F.lit(role).alias("role"))

    target = lineage.sparkSession.range(1).select(F.lit(center).alias("node"), F.lit("target").alias("node_type"))
    sources = queries.where(F.col("QUERY_TYPE").isin(TRANSFORMING)).select(F.explode(source_tables(
        F.col("QUERY_TEXT"), database, schema, table, **text)).alias("node")).withColumn("node_type", F.lit("source"))
    deps = lineage.where(F.col("SOURCE_VIEW") == "OBJECT_DEPENDENCIES")

    def end(p: str, kind: str) -> DataFrame:
        return deps.select(F.concat_ws(".", f"{p}_DATABASE", f"{p}_SCHEMA", f"{p}_TABLE").alias("node"),
                           F.lit(kind).alias("node_type"))

    found = (plain(target, 0).unionByName(changed).unionByName(plain(sources, 2))
             .unionByName(plain(end("SOURCE", "dependency_source"), 3))
             .unionByName(plain(end("TARGET", "dependency_target"), 4)))
    first = F.min(F.struct("role", "node_type", "query_type", "timestamp", "user"))
    return found.groupBy("node").agg(first.alias("r")).select(
        "node", "r.node_type", "r.query_type", "r.timestamp", "r.user")


def short_name(node: Column) -> Column:
    return F.element_at(F.split(node, r"\."), -1)


def edge_class(relationship: Column) -> Column:
    """Display class of an edge: transformation, dependency, update or other."""
    return (F.when(relationship.contains("transformation") | relationship.contains("create"), "transformation")
            .when(relationship.contains("dependency"), "dependency")
            .when(relationship.contains("update"), "update").otherwise("other"))


def transformation_summary(queries: DataFrame, database: str, schema: str, table: str, **text) -> DataFrame:
    """One row: transformations and distinct source tables."""
    count = queries.agg(F.count_if(F.col("QUERY_TYPE").isin(*TRANSFORMING, "UPDATE")).alias("transformations"))
    names = transformation_sources(queries, database, schema, table, **text).agg(
        F.count(F.lit(1)).alias("source_tables"))
    return count.crossJoin(F.broadcast(names))  # one row each


def transformation_sources(queries: DataFrame, database: str, schema: str, table: str, **text) -> DataFrame:
    """Distinct source tables with the number of queries that read them."""
    return queries.where(F.col("QUERY_TYPE").isin(TRANSFORMING)).select(F.explode(source_tables(
        F.col("QUERY_TEXT"), database, schema, table, **text)).alias("source")).groupBy("source").agg(
        F.count(F.lit(1)).alias("queries"))


def dependency_table(deps: DataFrame) -> DataFrame:
    """Dependencies under display names."""
    # Column and display name.
    names = {"SOURCE_DATABASE": "Source DB", "SOURCE_SCHEMA": "Source Schema", "SOURCE_TABLE": "Source Table",
             "TARGET_DATABASE": "Target DB", "TARGET_SCHEMA": "Target Schema", "TARGET_TABLE": "Target Table",
             "RELATIONSHIP_TYPE": "Relationship", "DEPENDENCY_CREATED": "Created On"}
    return deps.select(*[F.col(c).alias(n) for c, n in names.items()])


def dependency_summary(deps: DataFrame) -> DataFrame:
    """One row: dependencies, distinct source and target objects."""
    def ends(p: str) -> DataFrame:
        return deps.select(*[f"{p}_{x}" for x in ("DATABASE", "SCHEMA", "TABLE")]).distinct().agg(
            F.count(F.lit(1)).alias(f"unique_{p.lower()}s"))

    return deps.agg(F.count(F.lit(1)).alias("total_dependencies")).crossJoin(
        F.broadcast(ends("SOURCE"))).crossJoin(F.broadcast(ends("TARGET")))  # one row each


def access_summary(queries: DataFrame) -> DataFrame:
    """One row: queries, transformations, reads, distinct users."""
    kind = F.col("QUERY_TYPE")
    return queries.agg(
        F.count(F.lit(1)).alias("total_queries"), F.count_if(kind.isin(MODIFYING)).alias("transformations"),
        F.count_if(kind == "SELECT").alias("reads"), F.countDistinct("USER_NAME").alias("unique_users"))


def recent_reads(queries: DataFrame, k: int = 10, shown: int = 500) -> DataFrame:
    """The newest reads with their text cut for display."""
    reads = queries.where(F.col("QUERY_TYPE") == "SELECT")
    return newest(reads, "QUERY_START_TIME", k, "QUERY_ID").withColumn("shown_text", clipped("QUERY_TEXT", shown))


def sample_queries(queries: DataFrame, k: int = 3) -> DataFrame:
    """The newest query texts, whole."""
    dated = queries.where(F.col("QUERY_TEXT").isNotNull())
    return newest(dated, "QUERY_START_TIME", k, "QUERY_ID").select("QUERY_ID", "QUERY_TYPE", "QUERY_TEXT")


def clipped(column: str, shown: int) -> Column:
    """Text cut to ``shown`` characters with dots; the full text stays in its own column."""
    return F.when(F.length(column) > shown, F.concat(F.substring(column, 1, shown), F.lit("..."))).otherwise(F.col(column))


def daily_activity(queries: DataFrame) -> DataFrame:
    """Queries per day and type."""
    return queries.groupBy(F.to_date("QUERY_START_TIME").alias("day"), "QUERY_TYPE").agg(
        F.count(F.lit(1)).alias("queries"))


def ddl_summary(ddl: DataFrame) -> DataFrame:
    """One row: DDL operations, creates, alters."""
    return ddl.agg(F.count(F.lit(1)).alias("total_ddl"), F.count_if(F.col("DDL_ACTION") == "CREATE").alias("creates"),
                   F.count_if(F.col("DDL_ACTION") == "ALTER").alias("alters"))


def timeline(lineage: DataFrame) -> DataFrame:
    """Dated events: timestamp, event_type, description, category, execution_time."""
    view, kind = F.col("SOURCE_VIEW"), F.col("QUERY_TYPE")
    unknown = lambda c, text="Unknown": F.coalesce(F.col(c), F.lit(text))
    none = F.lit(None).cast("bigint")

    def event(at, what, told, category, took=none) -> Column:
        return F.struct(F.col(at).cast("timestamp").alias("timestamp"), what.alias("event_type"),
                        told.alias("description"), category.alias("category"), took.cast("bigint").alias("execution_time"))

    events = F.array_compact(F.array(
        F.when((view == "OBJECT_DEPENDENCIES") & F.col("DEPENDENCY_CREATED").isNotNull(), event(
            "DEPENDENCY_CREATED", F.lit("Dependency Created"),
            F.concat(F.lit("Dependency: "), F.col("SOURCE_TABLE"), F.lit(" → "), F.col("TARGET_TABLE")),
            F.lit("dependency"))),
        F.when(view.contains("QUERY_HISTORY") & F.col("QUERY_START_TIME").isNotNull(), event(
            "QUERY_START_TIME", F.concat(unknown("QUERY_TYPE"), F.lit(" Query")),
            F.concat(unknown("QUERY_TYPE"), F.lit(" by "), unknown("USER_NAME")),
            F.when(kind.isin(EVENT_TRANSFORMS), "transformation").otherwise("access"), F.col("TOTAL_ELAPSED_TIME"))),
        F.when(view.contains("DDL_HISTORY") & F.col("EXECUTION_TIME").isNotNull(), event(
            "EXECUTION_TIME", F.concat(F.lit("DDL "), unknown("DDL_ACTION")),
            F.concat(unknown("DDL_ACTION"), F.lit(" "), unknown("OBJECT_TYPE", "Object"), F.lit(" by "),
                     unknown("EXECUTED_BY")), F.lit("ddl")))))
    return lineage.select(F.inline(events))


def timeline_daily(events: DataFrame) -> DataFrame:
    """Events per day and category."""
    return events.groupBy(F.to_date("timestamp").alias("day"), "category").agg(F.count(F.lit(1)).alias("events"))


def timeline_summary(events: DataFrame) -> DataFrame:
    """One row: events per category and whole days between first and last."""
    span = F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))
    return events.agg(
        F.count_if(F.col("category") == "transformation").alias("transformations"),
        F.count_if(F.col("category") == "access").alias("access_events"),
        F.count_if(F.col("category") == "ddl").alias("ddl_changes"),
        F.floor(span / 86_400_000_000).alias("activity_days"))


def lineage_facts(lineage: DataFrame, k: int = 10) -> DataFrame:
    """Figures a reviewer reads first: fact, rank, value, count.

    query types, busiest users, busiest source-target pairs, busiest hours, date range.
    """
    def top(df: DataFrame, fact: str, value: Column, limit: int | None) -> DataFrame:
        counted = df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count"))
        ordered = counted.orderBy(F.desc("count"), "value")
        ordered = ordered.limit(limit) if limit else ordered
        return ordered.select(F.lit(fact).alias("fact"), "value", "count")

    queries = lineage.where(F.col("SOURCE_VIEW").contains("QUERY_HISTORY"))
    deps = lineage.where(F.col("SOURCE_VIEW") == "OBJECT_DEPENDENCIES")
    span = queries.agg(F.min("QUERY_START_TIME").alias("a"), F.max("QUERY_START_TIME").alias("b"),
                       F.count(F.lit(1)).alias("count")).select(
        F.lit("date_range").alias("fact"),
        F.concat(F.date_format("a", "yyyy-MM-dd HH:mm:ss"), F.lit(" to "), F.date_format("b", "yyyy-MM-dd HH:mm:ss"))
        .alias("value"), "count")
    pair = F.concat(F.col("SOURCE_TABLE"), F.lit(" -> "), F.col("TARGET_TABLE"))
    return (top(queries, "query_type", F.col("QUERY_TYPE"), None)
            .unionByName(top(queries, "user", F.col("USER_NAME"), k))
            .unionByName(top(deps, "pair", pair, k))
            .unionByName(top(queries, "hour", F.hour("QUERY_START_TIME").cast("string"), 5))
            .unionByName(span))

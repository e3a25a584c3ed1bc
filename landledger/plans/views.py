"""Land-record tables derived from the driver's base tables.

Each view is plain SQL in the common subset of Spark SQL and DuckDB, so the same
text feeds the operators and the checking engine. Names are ASCII because the
checking engine measures edit distance in bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger import fixed
from landledger.session import stored

NOW = "2026-09-11"

V_RECORDS = """
SELECT o_orderkey AS document_id,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL
       WHEN o_orderkey % 23 = 0 THEN g.w || ' ' || s.w || ' 7'
       WHEN o_orderkey % 17 = 0 THEN g.w || ' kumar'
       WHEN o_orderkey % 13 = 0 THEN 'shri ' || s.w || ' ' || g.w || ' kumar'
       WHEN o_orderkey % 11 = 0 THEN replace(g.w, 'a', 'e') || ' kumar ' || s.w
       ELSE g.w || ' kumar ' || s.w END AS owner_name,
  CAST(o_custkey % 311 AS STRING) AS survey_number,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL
       ELSE CAST(CAST(floor(o_custkey / 4) AS BIGINT) AS STRING) || '/' || CAST(o_orderkey % 31 AS STRING) END AS khasra_number,
  CAST(CAST(floor(o_custkey / 3) AS BIGINT) AS STRING) AS khata_number,
  CASE WHEN o_orderkey % 41 = 0 THEN 'unclear'
       WHEN o_orderkey % 43 = 0 THEN '0.000'
       WHEN o_orderkey % 47 = 0 THEN '20000.000'
       ELSE CAST(CAST((o_custkey % 500 + 500 + (o_orderkey % 7) * 9) / 1000.0 AS DECIMAL(12,3)) AS STRING) END AS plot_area,
  CASE WHEN o_orderkey % 19 = 0 THEN replace(v.w, 'pur', 'bur') ELSE v.w END AS village,
  'tehsil ' || v.w AS tehsil,
  'district ' || v.d AS district,
  CASE WHEN o_orderkey % 5 = 0 THEN 'irrigated' ELSE 'dry' END AS land_classification,
  CASE WHEN o_orderkey % 20 < 9 THEN 'VERIFIED' WHEN o_orderkey % 20 < 13 THEN 'PENDING'
       WHEN o_orderkey % 20 < 17 THEN 'FLAGGED' WHEN o_orderkey % 20 = 17 THEN 'REJECTED'
       WHEN o_orderkey % 20 = 18 THEN 'PROCESSING' ELSE 'UPLOADED' END AS status,
  CASE WHEN o_orderkey % 20 < 9 AND o_orderkey % 3 <> 0
       THEN 'UP' || lpad(CAST(o_orderkey AS STRING), 12, '0') ELSE NULL END AS ulpin,
  CAST((o_orderkey * 31) % 60 + 40 AS INT) AS conf_seed_pct,
  o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN (VALUES (0,'ramesh'),(1,'sunita'),(2,'kamala'),(3,'dinesh'),(4,'shanti'),(5,'anil'),(6,'geeta'),(7,'irfan'),(8,'savitri'),(9,'harish')) AS g(i, w) ON o_custkey % 10 = g.i
JOIN (VALUES (0,'verma'),(1,'mishra'),(2,'yadav'),(3,'tiwari'),(4,'gupta'),(5,'singh'),(6,'pandey')) AS s(i, w) ON o_custkey % 7 = s.i
JOIN (VALUES (0,'rampur khurd','north'),(1,'bhagwantpur','south'),(2,'salempur','east'),(3,'mubarakpur','west'),(4,'chandpur','east'),(5,'sultanpur kalan','north')) AS v(i, w, d) ON CAST(floor(o_custkey / 2) AS BIGINT) % 6 = v.i
"""

V_SOURCES = """
SELECT r.document_id AS source_id, src.name AS source, r.khasra_number, r.village, r.district,
  CASE WHEN src.name = 'CADASTRAL' THEN NULL
       WHEN src.name = 'REGISTRATION' AND r.document_id % 9 = 0 THEN 'mohan lal'
       ELSE r.owner_name END AS owner_name,
  CASE WHEN src.name = 'CADASTRAL' THEN NULL ELSE r.khata_number END AS khata_number,
  CASE WHEN src.name = 'CADASTRAL' AND r.document_id % 6 = 0 THEN '0.100' ELSE r.plot_area END AS plot_area,
  CASE WHEN src.name = 'ROR' THEN r.land_classification ELSE NULL END AS land_classification,
  CAST(2026 - r.document_id % 12 AS INT) AS as_of_year
FROM v_records r
JOIN (VALUES (0,'ROR'),(1,'REGISTRATION'),(2,'CADASTRAL')) AS src(i, name) ON r.document_id % 3 >= src.i
WHERE r.status = 'VERIFIED' AND r.document_id % 8 < 4 AND r.khasra_number IS NOT NULL
"""

# A register per order: its lines in order, seven to a parcel. Everything is local
# to one order, so building the view needs no global numbering.
V_MUTATIONS = """
SELECT id, parcel_id, seq, type, share, to_owner,
  CASE WHEN type = 'ORIGINAL' OR id % 61 = 0 THEN NULL
       WHEN id % 31 = 0 THEN 'stranger ' || CAST(id % 7 AS STRING)
       WHEN id % 17 = 0 OR (seq = 5 AND parcel_id % 3 = 0) THEN lag(to_owner, 2) OVER (PARTITION BY parcel_id ORDER BY seq)
       ELSE coalesce(lag(to_owner) OVER (PARTITION BY parcel_id ORDER BY seq), 'first seller') END AS from_owner,
  'M-' || CAST(CASE WHEN id % 53 = 0 AND seq > 1 THEN id - 1 ELSE id END AS STRING) AS mutation_number,
  CASE WHEN seq = 5 AND parcel_id % 3 = 0 THEN 400 ELSE seq * 100 END
    - CASE WHEN id % 29 = 0 THEN 450 ELSE 0 END + CASE WHEN id % 97 = 0 THEN 20000 ELSE 0 END AS effective_day,
  CASE WHEN seq > 3 AND id % 47 = 0 THEN id - 1 ELSE NULL END AS supersedes_id
FROM (
  SELECT id, parcel_id, seq,
    CASE WHEN seq = 1 AND parcel_id % 5 <> 0 THEN 'ORIGINAL'
         WHEN seq = 4 OR (seq = 5 AND parcel_id % 3 = 0) THEN 'INHERITANCE'
         WHEN seq = 2 AND parcel_id % 7 = 0 THEN 'GIFT' WHEN seq = 3 AND parcel_id % 11 = 0 THEN 'PARTITION'
         WHEN seq = 6 AND parcel_id % 13 = 0 THEN 'DECREE' ELSE 'SALE' END AS type,
    CASE WHEN id % 83 = 0 THEN 'half' WHEN id % 37 = 0 THEN '3/2'
         WHEN seq IN (4, 5) AND parcel_id % 3 = 0 THEN CASE WHEN id % 41 = 0 THEN '2/3' ELSE '1/2' END
         WHEN id % 19 = 0 THEN '1/2' WHEN id % 23 = 0 THEN '1/3' ELSE '1' END AS share,
    'owner ' || CAST(l_suppkey % 10 AS STRING) || ' of ' || CAST(seq AS STRING) AS to_owner
  FROM (
    SELECT (l_orderkey * 2 + CAST(floor(pos / 7) AS BIGINT)) * 8 + pos % 7 AS id, l_suppkey,
      l_orderkey * 2 + CAST(floor(pos / 7) AS BIGINT) AS parcel_id, CAST(pos % 7 + 1 AS INT) AS seq
    FROM (SELECT l_orderkey, l_suppkey,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS pos
      FROM lineitem) a) b) c
"""

# One register per distinct parcel; the register of the order with the smallest
# number among the records of the parcel.
V_PARCELS = """
SELECT 2 * min(document_id) AS parcel_id, khasra_number, village, district, min(tehsil) AS tehsil
FROM v_records WHERE khasra_number IS NOT NULL GROUP BY khasra_number, village, district
"""

V_BLOCKS = """
SELECT document_id, line_no, text, ((document_id * 31) % 60 + 40 + line_no % 3) / 100.0 AS confidence_dec FROM (
  SELECT document_id, 0 AS line_no, CASE WHEN document_id % 10 = 0 THEN 'Mutation order' ELSE 'Khatauni' END AS text FROM v_records
  UNION ALL SELECT document_id, 1, 'District: ' || district FROM v_records
  UNION ALL SELECT document_id, 2, 'Tehsil: ' || tehsil FROM v_records
  UNION ALL SELECT document_id, 3, 'Village: ' || village FROM v_records
  UNION ALL SELECT document_id, 4, 'Khata No. ' || khata_number FROM v_records
  UNION ALL SELECT document_id, 5, 'Khasra No. ' || khasra_number FROM v_records WHERE khasra_number IS NOT NULL
  UNION ALL SELECT document_id, 6, 'Survey No. ' || survey_number FROM v_records
  UNION ALL SELECT document_id, 7, 'Owner name: ' || owner_name FROM v_records WHERE owner_name IS NOT NULL
  UNION ALL SELECT document_id, 8, 'Plot area: ' || plot_area || ' ha' FROM v_records
  UNION ALL SELECT document_id, 9, 'Land class: ' || land_classification FROM v_records) t
"""

# Plots of a village; fifty to a village at every scale.
V_PLOTS = """
SELECT p_partkey AS plot_id, CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS STRING) AS village,
  'district ' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) % 4 AS STRING) AS district,
  CAST(p_partkey AS STRING) AS khasra,
  CAST((p_partkey * 37) % 400 AS DOUBLE) AS x0, CAST((p_partkey * 91) % 300 AS DOUBLE) AS y0,
  CAST(30 + p_size AS DOUBLE) AS w, CAST(40 + p_size % 25 AS DOUBLE) AS h
FROM part
"""

# Mutation orders as read off pages, one per register, with the faults a page has.
V_ORDERS = """
SELECT parcel_id * 8 + 7 AS document_id, parcel_id,
  CASE WHEN parcel_id % 44 = 0 THEN NULL ELSE CAST(parcel_id % 900 AS STRING) || '/2025' END AS mutation_number,
  CASE WHEN parcel_id % 26 = 0 THEN '31/02/2025' WHEN parcel_id % 34 = 0 THEN NULL
       ELSE lpad(CAST(parcel_id % 28 + 1 AS STRING), 2, '0') || '/' || lpad(CAST(parcel_id % 12 + 1 AS STRING), 2, '0') || '/2025' END AS order_date,
  CASE WHEN parcel_id % 38 = 0 THEN 'lease' WHEN parcel_id % 14 = 0 THEN 'Gift deed' WHEN parcel_id % 10 = 0 THEN 'inheritance' ELSE 'Sale' END AS mutation_type,
  CASE WHEN parcel_id % 46 = 0 THEN NULL WHEN parcel_id % 6 = 0 THEN 'stranger ' || CAST(parcel_id % 7 AS STRING) ELSE last_owner END AS from_owner,
  CASE WHEN parcel_id % 58 = 0 THEN NULL ELSE 'buyer ' || CAST(parcel_id % 10 AS STRING) END AS to_owner,
  CASE WHEN parcel_id % 22 = 0 THEN 'some' WHEN parcel_id % 8 = 0 THEN 'whole' WHEN parcel_id % 18 = 0 THEN '0.5' ELSE '1/2' END AS share,
  CASE WHEN parcel_id % 4 = 0 THEN CAST(parcel_id % 5000 AS STRING) || '/2024' ELSE NULL END AS deed_number,
  khasra_number, village, district,
  CASE WHEN parcel_id % 12 = 0 THEN 'VERIFIED' WHEN parcel_id % 12 = 2 THEN 'PENDING' WHEN parcel_id % 12 = 4 THEN 'FLAGGED' ELSE 'UPLOADED' END AS status,
  CAST((parcel_id * 31) % 60 + 40 AS INT) AS conf_seed_pct
FROM v_parcels JOIN (SELECT parcel_id AS pid, max_by(to_owner, seq) AS last_owner FROM v_mutations GROUP BY parcel_id) m ON parcel_id = pid
"""

VIEWS = {
    "v_records": (V_RECORDS, ["orders", "customer"]),
    "v_sources": (V_SOURCES, ["v_records"]),
    "v_mutations": (V_MUTATIONS, ["lineitem"]),
    "v_parcels": (V_PARCELS, ["v_records"]),
    "v_blocks": (V_BLOCKS, ["v_records"]),
    "v_plots": (V_PLOTS, ["part"]),
    "v_orders": (V_ORDERS, ["v_parcels", "v_mutations"]),
}


# Tables whose rows feed per-row text work. Line items are dealt out by order at once, so they are not among them.
_HEAVY = ("orders", "events", "part")
# Rows of those to a task. A row may become a hundred words, and what a task sorts should fit its memory.
TASK_ROWS = 50_000
# Rows of a table's files as far as asked in an application; they are told by the footers.
_ROWS: dict[tuple, int] = {}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table. Heavy ones are spread over the cores at least, and over more tasks the more rows they have."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df
    if name not in _HEAVY:
        return df
    cores, files = spark.sparkContext.defaultParallelism, tuple(df.inputFiles())
    key = (spark.sparkContext.applicationId, files)
    if key not in _ROWS:
        _ROWS[key] = df.count()
    wanted = max(cores, -(-_ROWS[key] // TASK_ROWS))
    return df.repartition(wanted) if len(files) < wanted else df


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A derived view as a lazy DataFrame over the base tables, or over views that were ``made`` before."""
    if name in (made or {}):
        return made[name]
    if name not in VIEWS:
        return base(spark, sf_dir, name)
    text, needs = VIEWS[name]
    frames = {need: view(spark, sf_dir, need, made) for need in needs}
    for need in sorted(needs, key=len, reverse=True):
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {need}", f"{word} {{{need}}}")
    return spark.sql(text, **frames)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their confidence map (keys only for fields that were read)."""
    df = view(spark, sf_dir, "v_records")
    return df.withColumn("confidence", seeded_confidence(fixed.RECORD_FIELDS)).drop("conf_seed_pct")


def seeded_confidence(fields: list[str]):
    """Confidence of field number f: ((seed + 7 f) mod 60 + 40) / 100, for fields present."""
    entries = ", ".join(
        f"if({f} is null, null, struct('{f}' as key, double((conf_seed_pct + {i * 7}) % 60 + 40) / 100.0D as value))"
        for i, f in enumerate(fields)
    )
    return F.expr(f"map_from_entries(array_compact(array({entries})))")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "v_sources")
    return df.withColumn("as_of", F.make_date("as_of_year", F.lit(1), F.lit(1)).cast("timestamp")).drop("as_of_year")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "v_mutations")
    start = F.lit("1990-01-01").cast("date")
    return df.withColumn("effective_date", F.date_add(start, F.col("effective_day").cast("int"))).drop("effective_day")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_parcels")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of v_blocks, written in one pass over the records."""
    return lines_of(view(spark, sf_dir, "v_records"))


def lines_of(records: DataFrame) -> DataFrame:
    """The pages of records, a line per field."""
    titles = {
        "District: ": "district", "Tehsil: ": "tehsil", "Village: ": "village", "Khata No. ": "khata_number",
        "Khasra No. ": "khasra_number", "Survey No. ": "survey_number", "Owner name: ": "owner_name",
        "Plot area: ": "plot_area || ' ha'", "Land class: ": "land_classification",
    }
    rows = ", ".join(f"{n}, '{title}' || {value}" for n, (title, value) in enumerate(titles.items(), 1))
    head = "if(document_id % 10 = 0, 'Mutation order', 'Khatauni')"
    return (
        records.selectExpr("document_id", f"stack({len(titles) + 1}, 0, {head}, {rows}) as (line_no, text)")
        .filter("text is not null")
        .withColumn("confidence", F.expr("double((document_id * 31) % 60 + 40 + line_no % 3) / 100.0D"))
    )


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "v_plots")
    corners = (
        "array(struct(x0 as x, y0 as y), struct(x0 + w as x, y0 as y), "
        "struct(x0 + w as x, y0 + h as y), struct(x0 as x, y0 + h as y))"
    )
    return df.selectExpr("plot_id", "district", "village", "khasra", f"{corners} as outline")


def made_once(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Registers and parcels as tables, for queries whose orders are derived from them too."""
    return {"v_mutations": stored(mutations(spark, sf_dir)), "v_parcels": stored(parcels(spark, sf_dir))}


def order_readings(spark: SparkSession, sf_dir: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    df = view(spark, sf_dir, "v_orders", made)
    return df.withColumn("confidence", seeded_confidence(fixed.ORDER_FIELDS)).drop("conf_seed_pct", "parcel_id")


def oracle_with(*names: str) -> str:
    """WITH clause that defines the named views, and what they need, for the checking engine."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in VIEWS or name in order:
            return
        for need in VIEWS[name][1]:
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({VIEWS[name][0]})" for name in order)

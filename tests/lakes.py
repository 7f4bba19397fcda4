"""A small lake of variant calls, as FIXTURES.md describes it."""

# The names a report and the joins need; ``weight`` is this lake's own.
CALLS = (
    "variant_hash bigint, validation_hash bigint, sample_name string, run_name string, "
    "chromosome string, position bigint, reference string, alternate string, snpeff_Gene_Name string, weight string"
)


def call(variant, key, sample, run, impact, position=100):
    return (variant, key, sample, run, "chr1", position, "A", "T", "BRCA1", impact)


RUN1 = [
    call(1, 11, "alice", "run1", "HIGH"),
    call(1, 12, "bob", "run1", "MODERATE", 101),
    call(2, 13, "alice", "run1", "LOW"),
    call(3, 14, None, "run1", "HIGH"),
    call(None, 15, "alice", "run1", "HIGH"),
    call(4, 16, "alice", "run1", None),
]
RUN2 = [
    call(1, 21, "alice", "run2", "HIGH"),
    call(5, 22, "o'hara", "run2", "HIGH", 77),
    call(6, 23, "o'hara", "run2", "MODERATE", 78),
    call(7, 24, "carol", "run2", "HIGH", 79),
]
COUNTS = "variant_hash bigint, ref_count bigint, var_count bigint, total_count bigint"
# variant 1 is rare, 5 exactly at the bound, 6 over nothing, 7 unknown, 3 twice, 99 in no run.
COUNT_ROWS = [
    (1, 995, 5, 1000),
    (2, 995, 5, 1000),
    (3, 1999, 1, 2000),
    (3, 1998, 2, 2000),
    (4, 10, 0, 10),
    (5, 98, 2, 100),
    (6, 0, 0, 0),
    (7, 1, 1, None),
    (99, 1, 0, 1),
]


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return path


def build(spark, root):
    runs = spark.createDataFrame(RUN2, CALLS)
    write(spark, f"{root}/genotypes/runs/run1.parquet", RUN1, CALLS)
    # Same columns in another order, and one more.
    runs.selectExpr(*reversed(runs.columns), "1 as extra").coalesce(1).write.parquet(f"{root}/genotypes/runs/run2.parquet")
    write(spark, f"{root}/seen/cohort.parquet", COUNT_ROWS, COUNTS)
    return ["genotypes/runs/run1.parquet", "genotypes/runs/run2.parquet"]


def field(name, table="main_table", **more):
    return {"name": name, "table": table, "is_expression": False, **more}


AGG = {
    "name": "'seen/cohort.parquet'",
    "alias": "seen",
    "quoted": False,
    "join": {"left_table": "main_table", "left_on": "variant_hash", "right_on": "variant_hash"},
}

RARE = {
    "title": "Seldom seen",
    "description": "Weighty calls of variants that one in fifty carries at most.",
    "tables": [AGG],
    "fields": [
        field("run_name"),
        field("sample_name"),
        field("position"),
        field("weight"),
        field("ref_count", "seen"),
        field("var_count", "seen"),
    ],
    "filters": {
        "$and": [
            {"expression": "main_table.weight <> 'LOW'"},
            {"expression": "50 * seen.var_count / seen.total_count < 1"},
        ]
    },
    "order": [{"field": "seen.total_count", "direction": "desc"}],
}

ALL_CALLS = {"title": "All", "description": "", "tables": [], "fields": [field("validation_hash"), field("sample_name")]}

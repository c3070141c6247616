"""Score tables: Parquet (plain or gzip-named), tab-separated and comma-separated text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varscore import schemas
from varscore.constants import KEY_COLUMNS, SCORE_ALIASES

_PARQUET_SUFFIXES = (".parquet", ".parquet.gz", ".parquet.gzip")


def _quoted(name):
    return "`" + name.replace("`", "``") + "`"


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; found {df.columns}")
    return df


def resolve_score(df: DataFrame, aliases=SCORE_ALIASES) -> DataFrame:
    """Rename the first alias present to `score` and drop the other aliases."""
    present = [a for a in aliases if a in df.columns]
    if not present:
        raise ValueError(f"no score column among {list(aliases)}; found {df.columns}")
    kept = [F.col(_quoted(c)) for c in df.columns if c not in present]
    return df.select(*kept, F.col(_quoted(present[0])).alias("score"))


def typed_keys(df: DataFrame) -> DataFrame:
    """CHROM, REF, ALT as text, POS as long, score as double; columns already typed stay untouched,
    so that filters on them still reach the Parquet reader. Text that is no number (`NA`, empty) becomes null."""
    kinds = {f.name: f.dataType.simpleString() for f in schemas.SCORES.fields}
    found = dict(df.dtypes)
    casts = {c: F.col(c).try_cast(k) for c, k in kinds.items() if c in found and found[c] != k}
    return df.withColumns(casts) if casts else df


def is_parquet(path: str) -> bool:
    return path.rstrip("/").endswith(_PARQUET_SUFFIXES)


def read_scores(spark: SparkSession, path: str, aliases=SCORE_ALIASES) -> DataFrame:
    """Read a score table; the suffix decides between Parquet, comma-separated (`.csv`) and tab-separated text.

    A gzip-named Parquet file is an ordinary Parquet file with gzip pages. A Parquet file that was gzipped
    as a whole has no readable footer: Spark reports it, and the caller has to gunzip it first.
    """
    if is_parquet(path):
        raw = spark.read.parquet(path)
    else:
        separator = "," if path.rstrip("/").endswith((".csv", ".csv.gz")) else "\t"
        raw = spark.read.csv(path, sep=separator, header=True, nullValue="")
    return require_columns(typed_keys(resolve_score(raw, aliases)), KEY_COLUMNS)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Read a train or test table written by `write_split`; columns are bound by the names in its header."""
    raw = require_columns(spark.read.csv(path, header=True), schemas.SPLIT.fieldNames())
    return raw.select(*[F.col(f.name).try_cast(f.dataType.simpleString()).alias(f.name) for f in schemas.SPLIT.fields])


def read_mutations(spark: SparkSession, path: str) -> DataFrame:
    """Read a protein-space mutation table."""
    return require_columns(spark.read.parquet(path), schemas.MUTATIONS.fieldNames())


def row_count(df: DataFrame) -> DataFrame:
    """One-row count; answered from Parquet footers when nothing else is selected."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))

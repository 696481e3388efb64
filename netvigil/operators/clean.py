"""Header repair, null and infinity handling, label mapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netvigil.operators.quantiles import exact_quantiles
from netvigil.schemas import ATTACK_CATEGORIES, FEATURE_HEADERS, SHORT_SPELLINGS, WEB_ATTACK_SUFFIXES

LONG_TO_SHORT = {long: short for short, long in FEATURE_HEADERS.items()}


def normalize_name(name: str) -> str:
    """Trim, lower-case, spaces to underscores."""
    return name.strip().lower().replace(" ", "_")


_NORMALIZED_TO_SHORT = {normalize_name(long): short for long, short in LONG_TO_SHORT.items()}


def canonical_name(name: str) -> str:
    """Canonical name of any known header spelling; unknown ones are normalized."""
    key = normalize_name(name)
    return SHORT_SPELLINGS.get(key) or _NORMALIZED_TO_SHORT.get(key) or key


def unique_names(names: list[str]) -> list[str]:
    """Repeat occurrences get a numeric suffix (the corpus repeats one header)."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append("fwd_header_length_2" if (n, seen[n]) == ("fwd_header_len", 2) else
                   n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(c) for c in df.columns])


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def repeated_headers(names: list[str]) -> dict[int, str]:
    """Positions whose known header was repeated in a CSV file: the reader marks every
    occurrence by appending its position."""
    stems = {
        i: n[: -len(str(i))].strip() for i, n in enumerate(names)
        if n.endswith(str(i)) and canonical_name(n) not in FEATURE_HEADERS
        and canonical_name(n[: -len(str(i))]) in FEATURE_HEADERS
    }
    listed = list(stems.values())
    return {i: s for i, s in stems.items() if listed.count(s) > 1}


def canonical_headers(df: DataFrame) -> DataFrame:
    """Rename to canonical names; two spellings of one feature become one coalesced column."""
    repeats = repeated_headers(df.columns)
    plain = [repeats.get(i, c) for i, c in enumerate(df.columns)]
    names = [canonical_name(c) for c in plain]
    if repeats:
        names = unique_names(names)
    positional = df.toDF(*[f"_c{i}" for i in range(len(names))])
    groups: dict[str, list[Column]] = {}
    for i, n in enumerate(names):
        groups.setdefault(n, []).append(F.col(f"_c{i}"))
    return positional.select(*[(F.coalesce(*cs) if len(cs) > 1 else cs[0]).alias(n) for n, cs in groups.items()])


def long_headers(df: DataFrame) -> DataFrame:
    """Canonical -> long corpus headers."""
    return df.withColumnsRenamed({s: l for s, l in FEATURE_HEADERS.items() if s in df.columns})


def keep_reference_columns(df: DataFrame, reference: list[str], label: str = "label") -> DataFrame:
    known = set(reference)
    return df.select(*[c for c in df.columns if c in known or c == label])


# Name fragments of columns that are not features (ports are features).
NON_FEATURES = ["source ip", "destination ip", "src_ip", "dst_ip", "protocol", "timestamp", "label",
                "attack type", "attack number"]


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose names mark no metadata."""
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and not any(p in f.name.lower() for p in NON_FEATURES)
    ]


def _spelling(name: str) -> str:
    """What spellings of one feature share: they differ in case, blanks and dashes only."""
    return name.lower().translate(str.maketrans(" -", "__"))


def _named(spellings: list[str]) -> str:
    """The first spelling with a blank, or the first."""
    return min(spellings, key=lambda n: (" " not in n, n))


def aligned_names(frames: list[DataFrame]) -> list[str]:
    """Sorted union of feature names; spellings of one feature count as one, called as ``_named`` says."""
    spellings: dict[str, list[str]] = {}
    for df in frames:
        for name in feature_columns(df):
            spellings.setdefault(_spelling(name), []).append(name)
    return sorted(map(_named, spellings.values()))


def align(frames: list[DataFrame]) -> list[DataFrame]:
    """Every frame with the same feature columns in the same order; missing ones null.

    A frame gives a feature under whatever spelling it has; of several spellings in one frame the first value that is not
    null counts, the chosen name's before others.
    """
    names = aligned_names(frames)

    def feature(df: DataFrame, name: str) -> Column:
        own = sorted((c for c in feature_columns(df) if _spelling(c) == _spelling(name)), key=lambda c: c != name)
        values = [F.col(f"`{c}`").cast("double") for c in own] or [F.lit(None).cast("double")]
        return F.coalesce(*values).alias(name)

    return [df.select(*[feature(df, c) for c in names]) for df in frames]


def union_aligned(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), align(frames))


def cast_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to double; unreadable text becomes null (``Infinity`` and ``NaN`` are numbers)."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns})


def is_infinite(c: Column) -> Column:
    return F.abs(c) == float("inf")


def finite_or_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinities and NaN become null."""
    return df.withColumns({c: F.when(~is_infinite(F.col(c)) & ~F.isnan(c), F.col(c)) for c in columns})


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinities, NaN and nulls become 0."""
    return df.withColumns(
        {c: F.when(~is_infinite(F.col(c)) & ~F.isnan(c), F.col(c)).otherwise(0.0) for c in columns}
    )


def median_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinities to null, then nulls to the exact median of their column."""
    cleaned = finite_or_null(df, columns)
    tally = cleaned.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns]).first().asDict()
    incomplete = [c for c in columns if tally[c] < tally["_rows"]]
    if not incomplete:
        return cleaned
    medians = exact_quantiles(cleaned, incomplete, 0.5, counts=tally)
    return cleaned.fillna({c: m for c, m in medians.items() if m is not None})


def drop_dirty(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with any null or non-finite value in the columns drop out."""
    return finite_or_null(df, columns).dropna("any", subset=columns)


def drop_sparse_columns(df: DataFrame, columns: list[str] | None = None, limit: float = 0.95) -> DataFrame:
    """Drop columns whose null fraction reaches the limit; one pass for all columns."""
    columns = columns or df.columns
    share = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if share[c] is not None and share[c] >= limit])


def missing_features(df: DataFrame, features: list[str]) -> list[str]:
    return [c for c in features if c not in df.columns]


def project_features(df: DataFrame, features: list[str] | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Model features in fixed order, missing ones as 0; without a list, all numeric columns."""
    if features is None:
        features = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keep]
    return df.select(
        *keep, *[(F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c) for c in features]
    )


def log_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """log1p of the listed columns; values at or below -1 become null."""
    return df.withColumns({c: F.log1p(c) for c in columns if c in df.columns})


def choose_log_columns(df: DataFrame, columns: list[str], limit: float = 100.0) -> list[str]:
    """Columns whose maximum exceeds the limit; fit once, persist, reuse at scoring."""
    top = df.agg(*[F.max(c).alias(c) for c in columns]).first()
    return [c for c in columns if top[c] is not None and top[c] > limit]


def attack_category(label: Column) -> Column:
    """Raw label -> category; web-attack labels match by prefix and suffix."""
    pairs = [F.lit(x) for kv in ATTACK_CATEGORIES.items() for x in kv]
    web = label.rlike(rf"^Web Attack\W*({'|'.join(WEB_ATTACK_SUFFIXES)})$")
    return F.when(web, "Web Attack").otherwise(
        F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit("Unknown"))
    )


def is_benign(label: Column) -> Column:
    return F.upper(F.trim(label)) == "BENIGN"


def split_benign(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    benign = F.coalesce(is_benign(F.col(label)), F.lit(False))
    return df.filter(benign), df.filter(~benign)


def downcast(df: DataFrame, columns: list[str]) -> DataFrame:
    """Storage option: double -> float and long -> int where the value range fits."""
    types = {f.name: f.dataType for f in df.schema.fields}
    bounds = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
    ).first()
    limits = {T.DoubleType: (3.4028234663852886e38, "float"), T.LongType: (2**31 - 1, "int")}
    casts = {}
    for c in columns:
        limit, target = limits.get(type(types[c]), (None, None))
        if limit and bounds[f"lo_{c}"] is not None and -limit < bounds[f"lo_{c}"] and bounds[f"hi_{c}"] < limit:
            casts[c] = F.col(c).cast(target)
    return df.withColumns(casts)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and surplus copies; equal rows combine before the shuffle."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"),
        F.sum(F.col("_n") - 1).alias("duplicates"),
    )


def merge_benign(frames: list[DataFrame], label: str = "BENIGN") -> DataFrame:
    """All captures united, labelled benign, exact duplicates removed."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.withColumn("label", F.lit(label)).dropDuplicates()

"""From files to clean, keyed measurement rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrapair.functions.ordered import with_running
from contrapair.session import materialise


def match_names(df: DataFrame, path: str, rules: list[tuple[str, str]]) -> DataFrame:
    """rule, model, instance, shot from the first rule whose pattern matches; each has groups instance, model, shot."""
    rule = F.coalesce(*[F.when(F.col(path).rlike(p), name) for name, p in rules])

    def part(g: int) -> Column:
        return F.coalesce(*[F.when(F.col("rule") == name, F.regexp_extract(path, p, g)) for name, p in rules])

    x = df.withColumn("rule", rule).where(F.col("rule").isNotNull())
    return x.withColumns({"instance": part(1), "model": part(2), "shot": part(3).cast("long")})


def screen_groups(df: DataFrame, model: str, device: str, need: int, devices: int = 2) -> DataFrame:
    """Models with at least `devices` devices of at least `need` items."""
    per = df.groupBy(model, device).agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy(model).agg(
        F.count_if(F.col("n") >= need).alias("n_ready"), F.count(F.lit(1)).alias("n_devices"), F.sum("n").alias("n_items")
    )
    return out.where(F.col("n_ready") >= devices)


def keep_modal_size(df: DataFrame, device: str, size: str) -> DataFrame:
    """Items whose size is their device's commonest (ties: the smallest), with the number dropped."""
    counts = df.groupBy(device, size).agg(F.count(F.lit(1)).alias("c"))
    best = materialise(counts.groupBy(device).agg(
        F.max_by(F.col(size), F.struct(F.col("c"), -F.col(size))).alias(size),
        (F.sum("c") - F.max("c")).alias("n_dropped"),
    ))
    return df.join(best, [device, size])


def dedup_content(df: DataFrame, content: str, name: str) -> DataFrame:
    """One row per SHA-256 with its smallest name and copy count; copies combine map-side."""
    return df.groupBy(F.sha2(content, 256).alias("sha")).agg(
        F.min(name).alias(name), F.count(F.lit(1)).alias("n_copies")
    )


def resolve_aliases(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Rename to canonical columns; exactly one declared alias of each must be present."""
    picked = []
    for canonical, aliases in names.items():
        found = [a for a in aliases if a in df.columns]
        if len(found) != 1:
            raise ValueError(f"{canonical}: expected one of {aliases}, found {found}")
        picked.append(F.col(found[0]).alias(canonical))
    return df.select(*picked)


def pool_sources(frames: dict[str, DataFrame], names: dict[str, list[str]]) -> DataFrame:
    out = None
    for source, df in frames.items():
        part = resolve_aliases(df, names).withColumn("source", F.lit(source))
        out = part if out is None else out.unionByName(part)
    return out


def string_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumns({k: F.col(k).cast("string") for k in keys})


def pending(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key has not been written yet."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def duplicate_status(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: its value and whether it is single, an identical repeat or a conflict."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.count(value).alias("n_values"),
    )
    clash = (F.col("lo") != F.col("hi")) | ((F.col("n_values") > 0) & (F.col("n_values") < F.col("n_rows")))
    status = F.when(F.col("n_rows") == 1, "single").when(F.coalesce(clash, F.lit(False)), "conflict").otherwise("identical")
    return out.select(*keys, "n_rows", F.col("lo").alias(value), status.alias("status"))


def collapse_duplicates(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key; a key with two different values stops the job."""
    s = duplicate_status(df, keys, value)
    fail = F.raise_error(F.lit("conflicting duplicate rows")).cast("double")
    return s.select(*keys, F.when(F.col("status") == "conflict", fail).otherwise(F.col(value)).alias(value))


def select_paths(df: DataFrame, document: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns from a JSON document by dotted path: {column: (path, type)}."""
    return df.withColumns({c: F.get_json_object(document, f"$.{p}").cast(t) for c, (p, t) in paths.items()})


def parse_log(df: DataFrame, line: str) -> DataFrame:
    """job, step, total, loss of every progress line ``[time] job step/total loss value``; other lines are dropped.

    Lines are read word by word, so a loss may be any number a double can hold, `nan` and exponents included.
    """
    word = F.split(F.trim(F.col(line)), r"\s+")
    count = F.split(F.get(word, F.lit(2)), "/")
    x = df.withColumns({
        "job": F.get(word, F.lit(1)), "step": F.get(count, F.lit(0)).try_cast("long"), "total": F.get(count, F.lit(1)).try_cast("long"),
        "loss": F.get(word, F.lit(4)).try_cast("double"),
    })
    stamped = F.get(word, F.lit(0)).startswith("[") & F.get(word, F.lit(0)).endswith("]")
    return x.where(stamped & (F.get(word, F.lit(3)) == "loss") & F.col("step").isNotNull() & F.col("total").isNotNull() & F.col("loss").isNotNull())


def last_complete_run(df: DataFrame, job: str, seq: str, step: str, first: int, steps: int) -> DataFrame:
    """Rows of each job's last run that logged every step from `first`; a restart begins a new run.

    Runs are numbered by a running count of first steps, so a job may hold any number of lines.
    """
    x = df.withColumn("__s", F.when(F.col(step) == first, 1).otherwise(0))
    x = with_running(x, [job], [seq], {"run": ("sum", "__s")}).drop("__s").where(F.col("run") > 0)
    x = materialise(x)
    full = x.groupBy(job, "run").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(step)).alias("d"), F.max(step).alias("hi")
    ).where((F.col("n") == steps) & (F.col("d") == steps) & (F.col("hi") == first + steps - 1))
    last = full.groupBy(job).agg(F.max("run").alias("run"))
    return x.join(last, [job, "run"])

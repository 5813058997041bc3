"""Label text as expressions (TXT1-5) and label columns (PRJ1-12, PRJ16-22). Null in, null or the stated default out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.functions import vocabulary as V


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def tokens(text: Column) -> Column:
    """Lower-cased, trimmed, non-empty parts between semicolons and commas; none for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[;,]")
    return F.filter(F.transform(parts, lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")


def parse_label(text: Column, vocabulary=V.TRANSMITTERS, out_of_scope=V.OUT_OF_SCOPE, ignored=V.IGNORED) -> Column:
    """TXT1: struct(single, mentioned, clean).

    single is the one label named, clean says that nothing else was: no ignored or negated token, none out of scope. Tokens in no
    list count for nothing. Only out-of-scope tokens named: no label. mentioned is sorted.
    """
    t = tokens(text)
    found = F.array_sort(F.array_intersect(F.array_distinct(t), _strings(vocabulary)))
    outside = F.arrays_overlap(t, _strings(out_of_scope))
    negated = lambda x: x.endswith("-negative") | x.isin(*ignored) if ignored else x.endswith("-negative")
    impure = outside | F.exists(t, negated)
    one = F.size(found) == 1
    return F.struct(F.when(one, found[0]).alias("single"), found.alias("mentioned"), (one & ~impure).alias("clean"))


def unknown_tokens(text: Column, vocabulary=V.TRANSMITTERS, out_of_scope=V.OUT_OF_SCOPE, ignored=V.IGNORED) -> Column:
    """TXT2: the distinct tokens that no list has and that are not negations."""
    named = F.filter(tokens(text), lambda t: ~t.endswith("-negative"))
    return F.array_distinct(F.array_except(named, _strings((*vocabulary, *out_of_scope, *ignored))))


def audit_tokens(df: DataFrame, column: str, **lists) -> DataFrame:
    """TXT2/TXT3: (token, cells) over the column's distinct values."""
    return df.select(column).distinct().select(F.explode(unknown_tokens(F.col(column), **lists)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("cells"))


def clean_lineage(text: Column, placeholder: str = "putative_primary", suffix: str = "__prim") -> Column:
    """TXT4: trimmed; null for nothing, the placeholder or the suffix."""
    value = F.trim(text)
    return F.when((value != "") & (value != placeholder) & ~value.endswith(suffix), value)


def derive_label(df: DataFrame, known: str, predicted: str, confidence: str, override: str = "histamine", outside=V.OUT_OF_SCOPE) -> DataFrame:
    """TXT5: adds nt_known, nt_known_clean, nt_train, nt_train_source and nt_conf.

    The override label, wherever it is mentioned, replaces the prediction; a text that only names labels out of scope takes it away.
    The confidence stays only where the prediction does. Out of scope is tested on the raw text, negations included.
    """
    p = parse_label(F.col(known))
    mentions_outside = F.coalesce(F.lower(F.col(known)).rlike("|".join(outside)), F.lit(False))
    overridden = F.array_contains(p["mentioned"], override)
    only_outside = mentions_outside & (F.size(p["mentioned"]) == 0)
    label = F.when(overridden, F.lit(override)).when(~only_outside, F.col(predicted))
    source = F.when(overridden, "known").when(label.isNotNull(), "predicted")
    return df.withColumns({
        "nt_known": p["single"],
        "nt_known_clean": p["clean"],
        "nt_train": label,
        "nt_train_source": source,
        "nt_conf": F.when(source == "predicted", F.col(confidence)),
    })


def derivation_report(df: DataFrame) -> DataFrame:
    """The counters beside TXT5, in one pass."""
    return df.agg(
        F.count_if(F.col("nt_known").isNotNull()).alias("known"),
        F.count_if("nt_known_clean").alias("known_clean"),
        F.count_if(F.col("nt_train_source") == "known").alias("overridden"),
        F.count_if(F.col("nt_train").isNull()).alias("unlabelled"),
        F.count_if(F.col("nt_conf").isNotNull()).alias("with_confidence"),
    )


def column_or_null(df: DataFrame, name: str) -> Column:
    """PRJ1: the column, or nulls where the frame has none of that name."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def harmonise(df: DataFrame, known: str = "nt_known", trained: str = "nt_train", side: str = "side", sides=V.SIDES) -> DataFrame:
    """PRJ8: the best label, and sides recoded; other values of side stay."""
    recoded = F.coalesce(*(F.when(F.col(side) == a, F.lit(b)) for a, b in sides.items()), F.col(side))
    return df.withColumns({"nt_best": F.coalesce(known, trained), side: recoded})


def mapped(df: DataFrame, column: str, pairs: dict[str, str | None], out: str) -> DataFrame:
    """PRJ7: values by a map in which null means no counterpart; a value that the map lacks is an error, null stays null."""
    known = F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), F.lit(v).cast("string"))))
    raw = F.col(column)
    lacking = raw.isNotNull() & ~F.map_contains_key(known, F.coalesce(raw, F.lit("")))
    return df.withColumn(out, F.when(lacking, F.raise_error(F.concat(F.lit(f"{column} has no entry for "), raw)).cast("string")).otherwise(F.try_element_at(known, raw)))


def in_scope(scope: str, region: str = "region", n_in: str = "n_in", n_out: str = "n_out") -> Column:
    """PRJ9: all, or the connected nodes of the brain."""
    if scope == "all":
        return F.lit(True)
    if scope == "brain":
        return F.coalesce((F.col(region) == "brain") & (F.col(n_in) + F.col(n_out) > 0), F.lit(False))
    raise ValueError(f"unknown scope {scope!r}: all or brain")


def restrict_split(split: Column, scope: Column) -> Column:
    """PRJ10."""
    return F.when(scope, split).otherwise("excluded")


def scope_mask(name: str, super_class: str = "super_class", central: str = "central", optic: str = "optic") -> Column:
    """PRJ11: whole_brain, central_brain or optic_lobe; a null class is in the first alone."""
    is_ = lambda v: F.coalesce(F.col(super_class) == v, F.lit(False))
    found = {"whole_brain": F.lit(True), "central_brain": is_(central), "optic_lobe": is_(optic)}
    if name not in found:
        raise ValueError(f"unknown scope {name!r}: one of {', '.join(found)}")
    return found[name]


def label_string(value: Column) -> Column:
    """PRJ12: a number without a fraction loses its point; null stays null."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def classified(value: Column, in_seen: Column, no_value: str = "absent") -> Column:
    """PRJ17/PRJ18: seen, unseen, or without a value."""
    return F.when(value.isNull(), no_value).when(in_seen, "seen").otherwise("unseen")


def pooled(value: Column, kept, other: str = "other") -> Column:
    """PRJ19."""
    return F.when(value.isin(*kept), value).otherwise(other)


def weighted(name: str, w: Column) -> Column:
    """PRJ20: binary, raw or log1p weights."""
    found = {"binary": F.lit(1.0), "raw": w.cast("double"), "log1p": F.log1p(w.cast("double"))}
    if name not in found:
        raise ValueError(f"unknown weighting {name!r}: one of {', '.join(found)}")
    return found[name]


def safe_ratio(a: Column, b: Column) -> Column:
    """PRJ21: 0 where the denominator is not positive."""
    return F.when(b > 0, a / b).otherwise(0.0)


def log2_ratio(a: Column, b: Column) -> Column:
    """PRJ22: null where it is not finite."""
    return F.when((a > 0) & (b > 0), F.log2(a / b))

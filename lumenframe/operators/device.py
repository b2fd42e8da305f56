"""Device classification: configured rules compiled to one Column expression.

Order: identifier rules, then the model table (exact, then either text within the
other), then the sanitised model, then ``Unknown``. Metadata is a map of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DeviceMapping
from ..functions import strip

#: Vendor names that a folder name loses, the first that fits.
VENDORS = ("NIKON CORPORATION", "NIKON", "Canon", "Sony", "Fujifilm", "Olympus", "Panasonic", "Leica", "DJI")
MODEL_TAGS = ("Model", "Camera Model Name", "Camera Model")
GRAM = 3
KIND = "struct<device_code:string,confidence:double,matched_fields:array<string>>"


def sanitised(name: Column) -> Column:
    """A folder name of at most 50 characters: no vendor, no characters that file systems refuse."""
    bare = strip(F.regexp_replace(strip(name), "(?iu)^(" + "|".join(VENDORS) + ")", ""))
    clean = F.regexp_replace(F.regexp_replace(bare, r'[<>:"/\\|?*]', "_"), r"(?U)[\s_]+", "_")
    return F.regexp_replace(F.substring(F.regexp_replace(clean, "^_+|_+$", ""), 1, 50), "_+$", "")


def camera_model(tags: Column) -> Column:
    """The first of the model tags that isn't empty, stripped."""
    return F.coalesce(*[strip(F.nullif(F.try_element_at(tags, F.lit(t)), F.lit(""))) for t in MODEL_TAGS], F.lit(""))


def _by_identifiers(tags: Column, config: DeviceMapping, unlisted_last: bool) -> Column:
    rank = {device: k for k, device in enumerate(config.priority_rules)}
    low = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(tags), lambda e: F.struct(F.lower(e["key"]), F.lower(strip(e["value"]))))))
    candidates = []
    for pos, (device, fields) in enumerate(config.exif_identifiers.items()):
        folded = {k.lower(): v.lower() for k, v in fields.items()}
        hits = F.array_compact(F.array(*[F.when(F.contains(F.try_element_at(low, F.lit(k)), F.lit(v)), k) for k, v in folded.items()]))
        # devices without a rank come before all that have one, unless asked otherwise
        order = -rank[device] if device in rank else (-len(rank) if unlisted_last else 1)
        row = F.struct((F.size(hits) / F.lit(float(len(folded)))).alias("share"), F.lit(order).alias("rank"), F.lit(-pos).alias("pos"), F.lit(device).alias("code"), hits.alias("hits"))
        candidates.append(F.when(F.size(hits) > 0, row))
    if not candidates:
        return F.lit(None).cast(KIND)
    best = F.array_max(F.array(*candidates))
    return F.when(best.isNotNull(), F.struct(best["code"].alias("device_code"), F.least(F.lit(0.9), best["share"]).alias("confidence"), best["hits"].alias("matched_fields")))


def _by_model(model: Column, config: DeviceMapping) -> Column:
    fields = F.array(F.lit("Model"))
    found = lambda code, confidence: F.struct(F.lit(code).alias("device_code"), F.lit(confidence).alias("confidence"), fields.alias("matched_fields"))
    low = F.lower(model)
    exact = [F.when(model == name, found(code, 0.8)) for name, code in config.mappings.items()]
    partial = [F.when(F.contains(low, F.lit(name.lower())) | F.contains(F.lit(name.lower()), low), found(code, 0.6)) for name, code in config.mappings.items()]
    return F.when(model != "", F.coalesce(*exact, *partial)) if exact else F.lit(None).cast(KIND)


def detect(tags: Column, config: DeviceMapping, unlisted_last: bool = False) -> Column:
    """struct(device_code, confidence, matched_fields, raw_camera_model)"""
    model = camera_model(tags)
    folder = sanitised(model)
    none = F.array().cast("array<string>")
    last = F.struct(
        F.when(folder != "", folder).otherwise("Unknown").alias("device_code"), F.when(folder != "", F.lit(0.3)).otherwise(F.lit(0.1)).alias("confidence"), none.alias("matched_fields")
    )
    best = F.coalesce(_by_identifiers(tags, config, unlisted_last), _by_model(model, config), last)
    return F.struct(best["device_code"].alias("device_code"), best["confidence"].alias("confidence"), best["matched_fields"].alias("matched_fields"), model.alias("raw_camera_model"))


def grams(text: Column, n: int) -> Column:
    """All stretches of n characters, each once."""
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short, long) of all pairs of texts (column ``text``, distinct in each) of which the first lies within the second.

    An inverted index: each short text is posted under its rarest trigram (itself, if it is shorter), and long ones look under
    all of theirs. The empty text lies within none here.
    """
    size = lambda: F.least(F.lit(GRAM), F.length("text"))
    any_size = F.flatten(F.array(*[grams(F.col("text"), n) for n in range(1, GRAM + 1)]))
    looks = long.select(F.col("text").alias("long"), F.explode(any_size).alias("gram"))
    own = short.where("text != ''").select("text", F.explode(F.when(size() < GRAM, F.array("text")).otherwise(grams(F.col("text"), GRAM))).alias("gram"))
    common = looks.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    posted = own.join(common, "gram", "left").groupBy("text").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return posted.join(looks, "gram").where(F.contains("long", F.col("text"))).select(F.col("text").alias("short"), "long").distinct()


def by_model(models: DataFrame, mappings: DataFrame, model_col: str = "model") -> DataFrame:
    """For each distinct model that a mapping fits: model, device_code, confidence.

    ``mappings``: place, name, device_code. An equal name counts 0.8, one that lies within the model or has it within, upper and lower
    case alike, 0.6; of several that of the least place. The same as the model rules of ``detect``, as joins: the plan
    doesn't grow with the number of mappings.
    """
    names = mappings.select("place", "name", "device_code")
    distinct = models.select(F.col(model_col).alias("model")).where("model is not null and model != ''").distinct().withColumn("low", F.lower("model"))
    first = lambda rows, confidence: rows.groupBy("model").agg(F.min_by("device_code", "place").alias("device_code")).withColumn("confidence", F.lit(confidence))
    equal = first(distinct.join(names, F.col("model") == F.col("name")), 0.8)
    rest = distinct.join(equal, "model", "left_anti")
    low_names, low_models = names.select(F.lower("name").alias("text")).distinct(), rest.select(F.col("low").alias("text")).distinct()
    pairs = contained(low_names, low_models).toDF("low_name", "low").unionByName(contained(low_models, low_names).toDF("low", "low_name")).distinct()
    partial = rest.join(pairs, "low").join(names.withColumn("low_name", F.lower("name")), "low_name")
    return equal.unionByName(first(partial.select("model", "place", "device_code"), 0.6))


def supported_devices(codes: DataFrame) -> DataFrame:
    """Every device that a rule names, once. ``codes``: code, a row a rule."""
    return codes.select(F.col("code").alias("device")).distinct()


def codes_of(config: DeviceMapping, spark) -> DataFrame:
    """The codes of a setting's identifier rules and mappings, a row a rule."""
    return spark.createDataFrame([(x,) for x in [*config.exif_identifiers, *config.mappings.values()]], "code string")


def lint(codes: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row an issue: issue, subject. ``codes``: a row a rule; ``ranked``: the codes of the priority rules."""
    devices = codes.select("code").distinct()
    unknown = ranked.join(devices, "code", "left_anti").select(F.lit("unknown priority").alias("issue"), F.col("code").alias("subject"))
    twice = codes.groupBy("code").count().where("count > 1").select(F.lit("duplicate code").alias("issue"), F.col("code").alias("subject"))
    folder = sanitised(F.col("code"))
    odd = devices.where(folder != F.col("code")).select(F.when(folder == "", "empty folder").otherwise("altered folder").alias("issue"), F.col("code").alias("subject"))
    return unknown.union(twice).union(odd)

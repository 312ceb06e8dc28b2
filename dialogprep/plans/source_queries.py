"""Queries of sources and streams: arrays in splits, landing, arriving turns."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogprep import schemas
from dialogprep.functions import arrays as ar
from dialogprep.functions import text as tx
from dialogprep.operators import index, inference, tokens
from dialogprep.operators.features import FeatureStore, digest
from dialogprep.plans import fixtures as fx
from dialogprep.plans import jobs
from dialogprep.plans.oracles import DIALOGUES, ORACLES as WHOLE, samples as samples_sql
from dialogprep.plans.queries import make_patch_means
from dialogprep.sources import images, records
from dialogprep.sources.inventory import Manifest, list_files
from dialogprep.sources.samples import SampleStore
from dialogprep.sources.scratch import scratch_dir
from dialogprep.streaming import dialogues, landing

QUERIES = {}
ORACLES = {}


def query(sql: str):
    def register(make):
        QUERIES[make.__name__] = make
        ORACLES[make.__name__] = sql
        return make

    return register


# One array


@query(f"""WITH {DIALOGUES}
SELECT row_number() OVER (ORDER BY conv_id) - 1 AS position, conv_id AS sample_id,
       conv_id * 7 || '.png' AS image, n_turns::INTEGER AS n_turns, text FROM dialogues""")
def one_array(spark, sf):
    """All records as a single array on a single line, read back by splits."""
    out = scratch_dir(spark, "array")
    fx.write_array(fx.records(spark, sf), out)
    found = records.positioned(records.read_parsed(spark, out))
    return found.select(
        "position", "sample_id", "image", F.size(tx.defaulted("conversations")).alias("n_turns"),
        tx.grouped_dialogue("conversations").alias("text"))


# Streams


def _landing_wave(records_, out, cut_every):
    line = F.to_json(F.struct("sample_id", "image", "conversations"))
    cut = F.when(F.col("sample_id") % cut_every == 0, F.substring(line, 1, 40)).otherwise(line)
    records_.select(cut.alias("value")).write.mode("append").text(out)


@query("""WITH records AS (
  SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id
)
SELECT CASE WHEN conv_id % 4 < 2 THEN 'lines' ELSE 'array' END AS layout,
       CASE WHEN conv_id % 4 < 2 AND conv_id % 10 = 0 THEN 'quarantined' ELSE 'good' END AS status,
       count(*) AS n_rows,
       sum(CASE WHEN conv_id % 4 < 2 AND conv_id % 10 = 0 THEN 0 ELSE n_turns END)::BIGINT AS n_turns,
       sum(CASE WHEN conv_id % 4 < 2 AND conv_id % 10 = 0 THEN 40 ELSE 0 END)::BIGINT AS n_chars
FROM records GROUP BY ALL""")
def stream_quarantine(spark, sf):
    """Lines, of which every tenth is cut, and an array arrive in two waves."""
    folder, out, progress = (scratch_dir(spark, n) for n in ("landing", "landed", "progress"))
    kind = F.col("sample_id") % 4
    rows = fx.records(spark, sf)
    _landing_wave(rows.where(kind == 0), f"{folder}/lines", 10)
    landing.land(spark, folder, out, progress).awaitTermination()
    _landing_wave(rows.where(kind == 1), f"{folder}/lines", 10)
    fx.write_array(rows.where(kind >= 2), f"{folder}/array")
    landing.land(spark, folder, out, progress).awaitTermination()
    good, held = landing.landed(spark, out)
    layout = F.when(F.col("file").contains("/lines/"), "lines").otherwise("array").alias("layout")
    kept = good.select(
        layout, F.lit(landing.GOOD).alias("status"), F.size("conversations").alias("n_turns"),
        F.lit(0).alias("n_chars"))
    lost = held.select(
        layout, F.lit(landing.HELD).alias("status"), F.lit(0).alias("n_turns"),
        F.length(schemas.CORRUPT).alias("n_chars"))
    return kept.unionByName(lost).groupBy("layout", "status").agg(
        F.count("*").alias("n_rows"), F.sum("n_turns").alias("n_turns"), F.sum("n_chars").alias("n_chars"))


@query(f"""WITH {DIALOGUES}
SELECT conv_id, 'complete' AS status, n_turns::INTEGER AS n_turns, text FROM dialogues
UNION ALL
SELECT conv_id, 'late', 1, coalesce(rendered, '') FROM conversations LEFT JOIN routed USING (conv_id, turn)
WHERE conv_id % 10 = 0 AND turn = 0""")
def stream_turns(spark, sf):
    """Turns arrive shuffled over files; then first turns of some dialogues come again."""
    turns = fx.table(spark, sf, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    marked = turns.join(last, "conv_id").select(
        "conv_id", "turn", "role", "text", (F.col("turn") == F.col("_last")).alias("is_last"))
    folder, out, progress = (scratch_dir(spark, n) for n in ("turns", "dialogues", "progress"))
    arriving = lambda: dialogues.collect_dialogues(
        spark.readStream.schema(marked.schema).option("maxFilesPerTrigger", 4).parquet(folder))
    marked.repartition(8, F.xxhash64("conv_id", "turn")).write.parquet(folder)
    dialogues.drain_dialogues(arriving(), out, progress)
    marked.where("conv_id % 10 = 0 AND turn = 0").coalesce(1).write.mode("append").parquet(folder)
    dialogues.drain_dialogues(arriving(), out, progress)
    return spark.read.parquet(out).select(
        "conv_id", "status", "n_turns", tx.grouped_dialogue("conversations").alias("text"))


# Kept inventories, features and samples

_FACTS = "height int, width int, readable boolean, digest string"


def _facts(spark):
    """What the manifest asks of image files, given their names."""
    def work(names):
        raw = images.read_images(spark, [records.literal_path(n) for n in names])
        return raw.select("path", "height", "width", "readable", digest(raw).alias("digest"))

    return work


def _image_id(path):
    return F.regexp_extract(path, r"(\d+)\.png$", 1).cast("long")


@query("""WITH files AS (
  SELECT vec_id AS image_id, CASE WHEN vec_id % 50 = 49 THEN -1 ELSE 8 END AS height FROM embeddings
  WHERE vec_id % 50 <> 48 AND NOT (vec_id % 11 = 0 AND vec_id % 3 = 0)
)
SELECT image_id,
       CASE WHEN image_id % 11 = 0 THEN 'removed' WHEN image_id % 3 = 0 THEN 'added'
            WHEN image_id % 5 = 0 THEN 'changed' ELSE 'same' END AS change,
       (CASE WHEN image_id % 11 = 0 THEN -1 ELSE height END)::INTEGER AS height,
       (CASE WHEN image_id % 11 = 0 THEN -1 WHEN image_id % 3 = 0 OR image_id % 5 = 0 THEN 2 ELSE 1 END)::BIGINT AS version
FROM files""")
def inventory_refresh(spark, sf):
    """A folder seen twice; files were added, written again and left out. The version tells
    in which run a file was decoded."""
    folder, path = scratch_dir(spark, "images"), scratch_dir(spark, "manifest")
    pictures = fx.image_rows(spark, sf)
    manifest = Manifest(spark, path, _FACTS)
    third = F.col("image_id") % 3 == 0
    fx.write_images(pictures.where(~third), folder)
    manifest.refresh(list_files(spark, folder), _facts(spark))
    again = ~third & (F.col("image_id") % 5 == 0)
    fx.write_images(pictures.where(third | again).withColumn("values", F.reverse("values")), folder)
    now = list_files(spark, folder).where(_image_id("path") % 11 != 0)
    changes = manifest.refresh(now, _facts(spark))
    return changes.select("path", "change").join(manifest.read(), "path", "left").select(
        _image_id("path").alias("image_id"), "change", F.coalesce("height", F.lit(-1)).alias("height"),
        F.coalesce("version", F.lit(-1).cast("long")).alias("version"))


@query(WHOLE["image_features"])
def features_once(spark, sf):
    """Features of a folder's pictures in two runs, of which the second knows half of them."""
    folder, path = scratch_dir(spark, "images"), scratch_dir(spark, "features")
    fx.write_images(fx.image_rows(spark, sf), folder)

    def pictures(names=None):
        raw = images.read_images(spark, folder, names)
        return raw.withColumn("digest", digest(raw))

    encoder = inference.predictor(make_patch_means, T.ArrayType(T.DoubleType()), 32, [[768]])

    def encode(new):
        tensors = images.pixel_values(new, size=16, method="nearest")
        return new.select("path", "digest").join(tensors, "path").select(
            "digest", encoder("pixel_values").alias("features"))

    store = FeatureStore(spark, path, "patch-means-1")
    store.attach(pictures("*[02468].png"), encode)
    known = store.attach(pictures(), encode).where("features IS NOT NULL")
    patches = F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("features", i * 3 + 1, F.lit(3)))
    return known.select(_image_id("path").alias("image_id"), F.posexplode(patches).alias("patch_pos", "p")).select(
        "image_id", "patch_pos", F.round(F.col("p")[0], 6).alias("red"),
        F.round(F.col("p")[1], 6).alias("green"), F.round(F.col("p")[2], 6).alias("blue"))


@query(f"""WITH {samples_sql()},
keys AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS idx FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT idx, conv_id, array_to_string(ids, ',') AS ids FROM samples JOIN keys USING (conv_id) WHERE idx IN (0, 7, 19)""")
def sample_store(spark, sf):
    """Samples written by position in shards of eight, three of them fetched."""
    turns = fx.table(spark, sf, "conversations")
    book = tokens.load_codebook(jobs.corpus_vocabulary(turns, fx.VOCABULARY_SIZE))
    store = SampleStore(spark, scratch_dir(spark, "samples"))
    positions = index.dense_index(turns.select("conv_id").distinct(), "conv_id")
    store.write(tokens.sample_ids(turns, book).select("conv_id", "ids"), positions, "conv_id", rows_per_shard=8)
    return store.fetch([0, 7, 19]).select("idx", "conv_id", ar.as_text("ids").alias("ids"))

"""Queries on sequences, tiles and file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.functions import names
from seqforge.operators import chunking, quality, sequences, tiling
from seqforge.plans import sql
from seqforge.plans.chunks import CUT
from seqforge.sources import adapters

L, TILE = 5, 256


def _listed(df: DataFrame, key: str, starts) -> DataFrame:
    return df.select(key, F.posexplode(starts).alias("k", "start")).select(key, F.col("k").cast("long").alias("k"), "start")


def _rows_sql(values: str, key: str = "chunk_no", source: str = "clips") -> str:
    return f"r AS (SELECT {key}, unnest({values}) AS start FROM {source}) SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY start) - 1 AS k, start FROM r"


def starts_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(adapters.clips(spark, sf_dir), "chunk_no", sequences.full_starts(F.col("n_frames"), L))


STARTS_FULL = f"WITH {sql.CLIPS}, {_rows_sql(f'range(1, n_frames - {L} + 2, {L})')}"


def starts_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of a second between sequences."""
    return _listed(adapters.clips(spark, sf_dir), "chunk_no", sequences.gap_starts(F.col("n_frames"), L, F.col("fps"), 0.34))


STARTS_GAP = f"WITH {sql.CLIPS}, {_rows_sql(f'range(1, n_frames - {L} + 2, {L} + trunc(0.34::DOUBLE * fps)::BIGINT)')}"


def thin_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most four starts, evenly spread."""
    starts = sequences.thinned(sequences.full_starts(F.col("n_frames"), L), 4)
    return _listed(adapters.clips(spark, sf_dir), "chunk_no", starts)


THIN_EVEN = f"""WITH {sql.CLIPS}, s AS (SELECT chunk_no, range(1, n_frames - {L} + 2, {L}) AS a FROM clips),
{_rows_sql("CASE WHEN len(a) > 4 THEN list_transform(range(4), lambda i: a[trunc(i * ((len(a) - 1) / 3.0::DOUBLE))::BIGINT + 1]) ELSE a END", source="s")}"""


def seq_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three starts of each clip."""
    return _listed(adapters.clips(spark, sf_dir), "chunk_no", F.slice(sequences.full_starts(F.col("n_frames"), L), 1, 3))


SEQ_CAP = f"SELECT * FROM ({STARTS_FULL}) WHERE k < 3"


def starts_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences at the starts of scenes."""
    signal = adapters.event_signal(spark, sf_dir)
    scenes = chunking.scenes(signal, CUT).groupBy("video_id").agg(F.sort_array(F.collect_list("start_frame")).alias("s"), F.max("end_frame").alias("n"))
    return _listed(scenes, "video_id", sequences.scene_starts(F.col("s"), F.col("n"), L))


STARTS_SCENE = f"""WITH {sql.SIGNAL}, cut AS (SELECT *, coalesce(score >= {CUT}, false) OR frame_no = 0 AS is_cut, count(*) OVER (PARTITION BY video_id) AS n FROM signal)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_no) - 1 AS k, frame_no + 1 AS start FROM cut WHERE is_cut AND frame_no + 1 + {L} <= n"""


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starts_full(spark, sf_dir).drop("k")


def seq_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global numbers over all clips."""
    return chunking.number_groups(_sequences(spark, sf_dir), "chunk_no", "start", name="seq_id").select("chunk_no", "start", "seq_id")


SEQ_NUMBER = f"SELECT chunk_no, start, row_number() OVER (ORDER BY chunk_no, start) AS seq_id FROM ({STARTS_FULL})"


def seq_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of the clips that have no extracted sequence yet."""
    have = adapters.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("chunk_no"))
    return sequences.missing(_sequences(spark, sf_dir), have, ["chunk_no"]).select("chunk_no", "start")


SEQ_SKIP_EXISTING = f"SELECT chunk_no, start FROM ({STARTS_FULL}) WHERE chunk_no NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"


def seq_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the sequences of five turns whose turns exist on both sides: all, and those of even length."""
    turns = adapters.conversation_frames(spark, sf_dir)
    high = turns.select("seq", F.col("frame_no").alias("src_frame"))
    low = adapters.table(spark, sf_dir, "conversations").where("length(text) % 7 <> 0").select(F.col("conv_id").alias("seq"), (F.col("turn") + 1).alias("src_frame"))
    n = turns.groupBy("seq").agg(F.count("*").alias("n"))
    wanted = n.select("seq", F.explode(sequences.full_starts(F.col("n"), 3)).alias("start"))
    frames = sequences.expanded(wanted, 3)
    done = sequences.complete(frames, high, low, ["seq", "src_frame"], ["seq", "start"], 3)
    return done.select("seq", "start", F.col("frame_no").cast("long").alias("frame_no"), F.col("src_frame").cast("long").alias("src_frame"))


SEQ_EXPAND = """WITH n AS (SELECT conv_id AS seq, count(*) AS n FROM conversations GROUP BY 1), s AS (SELECT seq, unnest(range(1, n - 1, 3)) AS start FROM n),
f AS (SELECT seq, start, unnest([1, 2, 3])::BIGINT AS frame_no FROM s), e AS (SELECT *, start + frame_no - 1 AS src_frame FROM f),
b AS (SELECT * FROM e WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = seq AND c.turn + 1 = src_frame AND length(c.text) % 7 <> 0))
SELECT seq, start, frame_no, src_frame FROM (SELECT *, count(*) OVER (PARTITION BY seq, start) AS c FROM b) WHERE c = 3"""


def extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips, clips with a sequence, sequences."""
    df = adapters.clips(spark, sf_dir).select(F.size(sequences.full_starts(F.col("n_frames"), L)).cast("long").alias("n"))
    return df.agg(F.count("*").alias("clips"), F.count_if(F.col("n") > 0).alias("used"), F.sum("n").alias("sequences"))


EXTRACT_SUMMARY = f"WITH {sql.CLIPS} SELECT count(*) AS clips, count(*) FILTER (n_frames >= {L}) AS used, sum(greatest(n_frames // {L}, 0))::BIGINT AS sequences FROM clips"


def seq_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapters.conversation_frames(spark, sf_dir)
    return df.select("seq", "frame_no", names.frame_name(F.col("seq"), F.col("frame_no")).alias("filename"), names.chunk_name(F.col("seq") * 99).alias("chunk"))


SEQ_NAMES = "SELECT conv_id AS seq, turn + 1 AS frame_no, printf('show%05d_Frame%05d.png', conv_id, turn + 1) AS filename, printf('chunk_%04d.mkv', conv_id * 99) AS chunk FROM conversations"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame files of all kinds of names."""
    d = adapters.table(spark, sf_dir, "conversations")
    kind = F.element_at(F.array(*map(F.lit, ["_Frame", "_frame", "-", "_Frame"])), (F.col("conv_id") % 4 + 1).cast("int"))
    extension = F.element_at(F.array(*map(F.lit, [".png", ".jpg", ".JPEG", ".bmp", ".txt"])), (F.col("turn") % 5 + 1).cast("int"))
    return d.select(F.concat(F.format_string("show%05d", F.expr("conv_id div 2")), kind, F.format_string("%05d", "turn"), extension).alias("filename"))


_NAMES = """n AS (SELECT printf('show%05d', conv_id // 2) || ['_Frame', '_frame', '-', '_Frame'][conv_id % 4 + 1] || printf('%05d', turn) || ['.png', '.jpg', '.JPEG', '.bmp', '.txt'][turn % 5 + 1] AS filename FROM conversations)"""


def name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of frame names by both patterns; null where one does not match."""
    f = F.col("filename")
    return _names(spark, sf_dir).select(
        "filename", names.parsed(f, names.TILE_NAME, 1).alias("prefix"), names.parsed(f, names.TILE_NAME, 2).alias("scene"), names.parsed(f, names.TILE_NAME, 3).cast("long").alias("tile_frame"),
        names.parsed(f, names.SEQUENCE_NAME, 1).alias("sequence"), names.parsed(f, names.SEQUENCE_NAME, 2).cast("long").alias("frame"),
    )


_TILE_RE, _SEQ_RE = r"^(.*?)(\d+)_[fF]rame(\d+)\.[A-Za-z]+$", r"^(.+)_Frame(\d+)\.(png|jpg|jpeg)$"
NAME_PARSE = f"""WITH {_NAMES} SELECT filename, nullif(regexp_extract(filename, '{_TILE_RE}', 1), '') AS prefix, nullif(regexp_extract(filename, '{_TILE_RE}', 2), '') AS scene,
nullif(regexp_extract(filename, '{_TILE_RE}', 3), '')::BIGINT AS tile_frame, nullif(regexp_extract(filename, '{_SEQ_RE}', 1), '') AS sequence, nullif(regexp_extract(filename, '{_SEQ_RE}', 2), '')::BIGINT AS frame FROM n"""


def frames_by_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame files by scene, in frame order: place, file."""
    from pyspark.sql import Window

    f = F.col("filename")
    rows = _names(spark, sf_dir).where(f.rlike(names.TILE_EXTENSIONS) & f.rlike(names.TILE_NAME))
    rows = rows.select(names.parsed(f, names.TILE_NAME, 2).alias("scene"), names.parsed(f, names.TILE_NAME, 3).cast("long").alias("frame"), "filename")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("scene").orderBy("frame", "filename")).cast("long"))


FRAMES_BY_SCENE = f"""WITH {_NAMES}, m AS (SELECT regexp_extract(filename, '{_TILE_RE}', 2) AS scene, regexp_extract(filename, '{_TILE_RE}', 3)::BIGINT AS frame, filename FROM n
  WHERE regexp_matches(filename, '{_TILE_RE}') AND regexp_matches(filename, '\\.(png|jpg|jpeg|bmp|tiff)$', 'i'))
SELECT *, row_number() OVER (PARTITION BY scene ORDER BY frame, filename) AS place FROM m"""


def frames_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each sequence; frame 0 does not count."""
    f = F.col("filename")
    rows = _names(spark, sf_dir).select(names.parsed(f, names.SEQUENCE_NAME, 1).alias("sequence"), names.parsed(f, names.SEQUENCE_NAME, 2).cast("long").alias("frame")).where("frame <> 0")
    return rows.groupBy("sequence").agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"))


FRAMES_BY_SEQUENCE = f"""WITH {_NAMES}, m AS (SELECT regexp_extract(filename, '{_SEQ_RE}', 1) AS sequence, nullif(regexp_extract(filename, '{_SEQ_RE}', 2), '')::BIGINT AS frame FROM n WHERE regexp_matches(filename, '{_SEQ_RE}'))
SELECT sequence, count(*) AS n, min(frame) AS first, max(frame) AS last FROM m WHERE frame <> 0 GROUP BY sequence"""


def scan_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame files of two extensions in any case, in order of name."""
    df = _names(spark, sf_dir)
    return df.where(names.has_extension(F.col("filename"), ("jpeg", "bmp"))).select("filename").orderBy("filename")


SCAN_BY_EXTENSION = f"WITH {_NAMES} SELECT filename FROM n WHERE regexp_matches(lower(filename), '\\.(jpeg|bmp)$') ORDER BY filename"


def path_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem of every url with an extension put on."""
    path = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.element_at(F.array(*map(F.lit, [".mp4", ".tar.gz", "", "/.hidden"])), (F.col("page_id") % 4 + 1).cast("int")))
    return adapters.table(spark, sf_dir, "pages").select("page_id", names.stem(path).alias("stem"), names.basename(path).alias("basename"))


PATH_STEM = r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || ['.mp4', '.tar.gz', '', '/.hidden'][page_id % 4 + 1] AS path FROM pages), b AS (SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS b FROM p)
SELECT page_id, CASE WHEN strpos(b[2:], '.') = 0 THEN b ELSE regexp_replace(b, '\.[^.]*$', '') END AS stem, b AS basename FROM b"""


def pair_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.pairs(adapters.high_files(spark, sf_dir), adapters.low_files(spark, sf_dir)).select("basename")


PAIR_INNER = f"WITH {sql.FILES} SELECT basename FROM high JOIN low USING (basename)"


def pair_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.unpaired(adapters.high_files(spark, sf_dir), adapters.low_files(spark, sf_dir)).select("basename")


PAIR_MISSING = f"WITH {sql.FILES} SELECT basename FROM high WHERE basename NOT IN (SELECT basename FROM low)"


def chunk_pairs_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degraded path that belongs to each high-quality one."""
    return adapters.high_files(spark, sf_dir).select(F.concat(F.lit("HR/"), "basename").alias("hr_path"), F.concat(F.lit("LR/"), "basename").alias("lr_path"), names.chunk_number(F.col("basename")).alias("chunk_no"))


CHUNK_PAIRS_DERIVE = "SELECT printf('HR/chunk_%04d.mkv', o_orderkey) AS hr_path, printf('LR/chunk_%04d.mkv', o_orderkey) AS lr_path, o_orderkey AS chunk_no FROM orders"


def sync_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.orphans(adapters.high_files(spark, sf_dir), adapters.low_files(spark, sf_dir), "basename").select("basename")


SYNC_ORPHANS = f"WITH {sql.FILES} SELECT basename FROM low WHERE basename NOT IN (SELECT basename FROM high)"


def compare_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compared(adapters.high_files(spark, sf_dir), adapters.low_files(spark, sf_dir), "basename")


COMPARE_TWO_WAY = f"""WITH {sql.FILES} SELECT basename, 'baseline_only' AS side FROM (SELECT basename FROM high EXCEPT SELECT basename FROM low)
UNION ALL SELECT basename, 'secondary_only' FROM (SELECT basename FROM low EXCEPT SELECT basename FROM high)"""


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.grid(adapters.geometry(spark, sf_dir), TILE, TILE).select("id", "x", "y", "tile_idx")


_GRID = f"""grid AS (SELECT id, tx * {TILE} AS x, ty * {TILE} AS y, ty * (width // {TILE}) + tx AS tile_idx FROM (SELECT id, width, unnest(range(width // {TILE})) AS tx, height FROM geometry) a,
  range(0, 64) b(ty) WHERE ty < height // {TILE})"""
TILE_GRID = f"WITH {sql.GEOMETRY}, {_GRID} SELECT id, x, y, tile_idx FROM grid"


def tile_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = tiling.grid(adapters.geometry(spark, sf_dir), TILE, TILE)
    return tiling.shuffled(tiles, "id", 1024).select("id", "x", "y", "tile_idx")


TILE_SHUFFLE = f"WITH {sql.GEOMETRY}, {_GRID} SELECT id, x, y, row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws('|', '1024', id, x, y)), y, x) - 1 AS tile_idx FROM grid"


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tiling.windows(adapters.conversation_frames(spark, sf_dir), "seq", "frame_no", 3)
    return df.select("seq", F.col("window_no").cast("long").alias("window_no"), F.col("offset").cast("long").alias("offset"), "frame_no")


SLIDING_WINDOWS = """WITH n AS (SELECT conv_id AS seq, count(*) AS n FROM conversations GROUP BY 1), w AS (SELECT seq, unnest(range(0, n - 2)) AS window_no FROM n)
SELECT seq, window_no, o AS "offset", window_no + o + 1 AS frame_no FROM w, range(3) t(o)"""


def tile_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three frames times the four tiles of an 8 x 8 image: pixel sums of each tile.

    Frames are cut into tiles once; windows repeat the tiles' sums, not the pixels.
    """
    frames = adapters.embedding_frames(spark, sf_dir)
    grid = tiling.grid(spark.createDataFrame([(8, 8)], "width int, height int"), 4, 4).select("x", "y", "tile_idx")
    total = F.aggregate("tile_pixels", F.lit(0).cast("long"), lambda a, v: a + v)
    tiles = tiling.cut(frames.crossJoin(F.broadcast(grid)), 4, 4).groupBy("seq", "frame_no").agg(F.collect_list(F.struct("tile_idx", total.alias("px_sum"))).alias("tiles"))
    rows = tiling.windows(tiles, "seq", "frame_no", 3).select("seq", "window_no", "frame_no", F.inline("tiles"))
    return rows.select("seq", F.col("window_no").cast("long").alias("window_no"), F.col("frame_no").cast("long").alias("frame_no"), "tile_idx", "px_sum")


TILE_EXPAND = f"""WITH {sql.FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY frame_no) - 1 AS p, count(*) OVER (PARTITION BY seq) AS c FROM frames),
t AS (SELECT seq, frame_no, p, c, (i // 8 // 4) * 2 + (i % 8) // 4 AS tile_idx, sum(pixels[i + 1])::BIGINT AS px_sum FROM n, range(64) r(i) GROUP BY ALL)
SELECT seq, w AS window_no, frame_no::BIGINT AS frame_no, tile_idx, px_sum FROM t, range(8) x(w) WHERE w <= p AND p < w + 3 AND w <= c - 3"""


def tile_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first show number of each scene (supplier by name): windows times tiles of the scenes before it."""
    s = adapters.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("scene"), (F.col("s_suppkey") % 7).alias("n_windows"), (F.col("s_nationkey") % 5 + 1).cast("long").alias("n_tiles"))
    return tiling.numbered(s, "scene", "n_windows", "n_tiles")


TILE_NUMBER = """WITH s AS (SELECT s_name AS scene, s_suppkey % 7 AS n_windows, (s_nationkey % 5 + 1)::BIGINT AS n_tiles FROM supplier)
SELECT *, (1 + coalesce(sum(n_windows * n_tiles) OVER (ORDER BY scene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first_show FROM s"""


def tile_pair_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and size of each degraded tile, from its high-quality tile's index."""
    tiles = tiling.grid(adapters.geometry(spark, sf_dir), TILE, TILE)
    low = tiling.low_size(TILE, 50)
    return tiles.select("id", "tile_idx", (F.col("x") / TILE * low).cast("long").alias("lr_x"), (F.col("y") / TILE * low).cast("long").alias("lr_y"), F.lit(low).cast("long").alias("lr_size"))


TILE_PAIR_SIZES = f"WITH {sql.GEOMETRY}, {_GRID} SELECT id, tile_idx, x // 2 AS lr_x, y // 2 AS lr_y, {TILE // 2}::BIGINT AS lr_size FROM grid"

_NAMES_OF = (
    "starts_full starts_gap thin_even seq_cap starts_scene seq_number seq_skip_existing seq_expand extract_summary seq_names name_parse frames_by_scene frames_by_sequence"
    " scan_by_extension path_stem pair_inner pair_missing chunk_pairs_derive sync_orphans compare_two_way tile_grid tile_shuffle sliding_windows tile_expand tile_number tile_pair_sizes"
).split()
QUERIES = {n: globals()[n] for n in _NAMES_OF}
ORACLES = {n: globals()[n.upper()] for n in _NAMES_OF}

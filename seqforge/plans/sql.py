"""DuckDB SQL of the model tables, as common table expressions, and of keyed draws."""

FRAMES = """frames AS (SELECT vec_id // 5 AS seq, (vec_id % 5 + 1)::INTEGER AS frame_no, 8 AS width, 8 AS height, label, vec_id,
  list_transform(embedding, lambda e: least(greatest(floor((e::DOUBLE + 1) * 128)::INTEGER, 0), 255)) AS pixels FROM embeddings)"""

BOXED = (
    FRAMES
    + """, boxed AS (SELECT * REPLACE (CASE WHEN vec_id % 7 = 0 THEN list_transform(range(64), lambda i: CASE WHEN i BETWEEN 16 AND 47 THEN pixels[i + 1] ELSE 0 END)
  ELSE pixels END AS pixels) FROM frames)"""
)

STITCHED = (
    FRAMES
    + """, part AS (SELECT vec_id // 4 AS seq, vec_id % 4 AS k, CASE WHEN vec_id % 20 < 2 THEN list_transform(pixels, lambda v: 0) ELSE pixels END AS p FROM frames),
four AS (SELECT seq, max(p) FILTER (k = 0) AS a, max(p) FILTER (k = 1) AS b, max(p) FILTER (k = 2) AS c, max(p) FILTER (k = 3) AS d FROM part GROUP BY seq HAVING count(*) = 4),
stitched AS (SELECT seq, 1 AS frame_no, 16 AS width, 16 AS height,
  list_transform(range(256), lambda i: CASE WHEN i // 16 < 8 AND i % 16 < 8 THEN a[(i // 16) * 8 + i % 16 + 1] WHEN i // 16 < 8 THEN b[(i // 16) * 8 + i % 16 - 7]
    WHEN i % 16 < 8 THEN c[(i // 16 - 8) * 8 + i % 16 + 1] ELSE d[(i // 16 - 8) * 8 + i % 16 - 7] END) AS pixels FROM four)"""
)

RECORDINGS = FRAMES + """, recordings AS (SELECT seq AS video_id, * EXCLUDE (seq) FROM frames WHERE label <> 7)"""

SHOTS = (
    FRAMES
    + """, shots AS (SELECT n // 7 AS video_id, (n % 7 + 1)::INTEGER AS frame_no, 8 AS width, 8 AS height, blue, green, red FROM (SELECT vec_id // 3 AS n, max(pixels) FILTER (vec_id % 3 = 0) AS blue,
  max(pixels) FILTER (vec_id % 3 = 1) AS green, max(pixels) FILTER (vec_id % 3 = 2) AS red, max(label) FILTER (vec_id % 3 = 0) AS label FROM frames GROUP BY 1)
  WHERE blue IS NOT NULL AND green IS NOT NULL AND red IS NOT NULL AND label <> 7)"""
)

SIGNAL = """signal AS (SELECT user_id AS video_id, row_number() OVER w - 1 AS frame_no, abs(value - lag(value) OVER w) AS score
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

CLIPS = """clips AS (SELECT l_orderkey AS chunk_no, sum(l_quantity)::BIGINT AS n_frames, [24.0, 25.0, 30.0][l_orderkey % 3 + 1]::DOUBLE AS fps
  FROM lineitem GROUP BY l_orderkey)"""

GEOMETRY = """geometry AS (SELECT p_partkey AS id, (p_size * 64 + p_partkey % 7)::BIGINT AS width, (p_size * 36 + p_partkey % 5)::BIGINT AS height,
  CASE p_partkey % 4 WHEN 0 THEN 'smpte2084' WHEN 1 THEN 'bt709' END AS color_transfer,
  CASE WHEN p_partkey % 6 = 1 THEN 'bt2020nc' ELSE 'bt709' END AS color_space, CASE WHEN p_partkey % 9 = 2 THEN 'bt2020' END AS color_primaries,
  ['25/1', '30000/1001', '0/0', '24', 'x', '30/0'][p_partkey % 6 + 1] AS frame_rate FROM part)"""

FILES = """high AS (SELECT printf('chunk_%04d.mkv', o_orderkey) AS basename FROM orders),
lowkeys AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 11 <> 0),
low AS (SELECT printf('chunk_%04d.mkv', k) AS basename FROM (SELECT k FROM lowkeys UNION ALL SELECT k + 10000000 FROM lowkeys WHERE k % 13 = 0))"""


def unit(name: str, key: str, seed: int = 1024) -> str:
    """A keyed draw in [0, 1)."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{name}', {key})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def randint(name: str, key: str, low: int, high: int, seed: int = 1024) -> str:
    return f"({low} + floor({unit(name, key, seed)} * {high - low + 1})::BIGINT)"


def uniform(name: str, key: str, low: float, high: float, places: int) -> str:
    return randint(name, key, round(low * 10**places), round(high * 10**places))


def choice(name: str, key: str, options: list[str]) -> str:
    listed = ", ".join(f"'{o}'" for o in options)
    return f"([{listed}][floor({unit(name, key)} * {len(options)})::INTEGER + 1])"


def decimal(n: str, places: int) -> str:
    """An integer in units of the last decimal, as text."""
    return f"(CASE WHEN {n} < 0 THEN '-' ELSE '' END || (abs({n}) // {10**places})::VARCHAR || '.' || lpad((abs({n}) % {10**places})::VARCHAR, {places}, '0'))"


def even(n: str) -> str:
    return f"greatest(({n}) // 2 * 2, 2)::BIGINT"


def cells(name: str, source: str, key: str, values: str, size: str = "width, height") -> str:
    """A table of pixels: key, size, x, y and a value ``v`` from an array."""
    w = size.split(", ")[0]
    return f"{name} AS (SELECT {key}, {size}, i % {w} AS x, i // {w} AS y, v::BIGINT AS v FROM (SELECT {key}, {size}, unnest({values}) AS v, unnest(range(len({values}))) AS i FROM {source}))"


def texted(source: str, keys: str, column: str = "v", name: str = "pixels") -> str:
    """One row for each frame: its pixels in order, as text."""
    return f"SELECT {keys}, string_agg({column}::VARCHAR, ',' ORDER BY y, x) AS {name} FROM {source} GROUP BY {keys}"


def box(name: str, source: str, key: str, rx: str, ry: str | None = None) -> str:
    """sum ``s`` and number ``n`` of the pixels within rx columns and ry rows."""
    return f"""{name} AS (SELECT a.*, t.s, t.n FROM {source} a JOIN (SELECT a.{key} AS k, a.x, a.y, sum(b.v)::BIGINT AS s, count(*) AS n FROM {source} a JOIN {source} b
  ON a.{key} = b.{key} AND abs(a.x - b.x) <= a.{rx} AND abs(a.y - b.y) <= a.{ry or rx} GROUP BY ALL) t ON a.{key} = t.k AND a.x = t.x AND a.y = t.y)"""


def scramble(source: str, column: str, out: str) -> str:
    """``source`` with one step of a permuted congruential generator on a 32-bit column."""
    one = f"SELECT *, ({column} * 747796405 + 2891336453) & 4294967295 AS t1 FROM ({source})"
    two = f"SELECT *, (xor(t1 >> ((t1 >> 28) + 4), t1) * 277803737) & 4294967295 AS t2 FROM ({one})"
    return f"SELECT * EXCLUDE (t1, t2), xor(t2 >> 22, t2) AS {out} FROM ({two})"

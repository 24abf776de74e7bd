"""DuckDB SQL that derives the request tables and repeats the parsing rules, for the oracle."""

from __future__ import annotations

# Fixed values, written down apart from the code under test: names, extensions and aliases of requests.
FORMATS = {"jpg": "jpg", "jpeg": "jpg", "png": "png", "webp": "webp", "avif": "avif", "pdf": "pdf"}
ROTATIONS = {
    "90": 270, "left": 270, "anticlockwise": 270,
    "180": 180, "bottom-up": 180, "upside-down": 180,
    "270": 90, "right": 90, "clockwise": 90,
}
COLOURS = {"transparent": (0, 0, 0, 0), "black": (0, 0, 0, 255), "white": (255, 255, 255, 255)}
ORIGINS = {
    "top-left": "top-left", "left-top": "top-left",
    "top-center": "top-center", "center-top": "top-center", "top": "top-center",
    "top-right": "top-right", "right-top": "top-right",
    "left-center": "left-center", "center-left": "left-center", "left": "left-center",
    "right-center": "right-center", "center-right": "right-center", "right": "right-center",
    "bottom-left": "bottom-left", "left-bottom": "bottom-left",
    "bottom-center": "bottom-center", "center-bottom": "bottom-center", "bottom": "bottom-center",
    "bottom-right": "bottom-right", "right-bottom": "bottom-right",
}
DOCUMENTS = ["doc", "docx", "odt", "xls", "xlsx", "ods", "ppt", "pptx", "odp", "rtf"]
RASTER = ["jpg", "jpeg", "png", "webp", "gif", "bmp", "tif", "tiff", "ico", "svg", "heic", "heif", "jp2", "jpm", "jpx", "jpf", "avif", "avifs"]
OPAQUE = ["jpg", "jpeg"]


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _case(n: str, choices: list[str]) -> str:
    return "CASE " + n + " " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(choices)) + " ELSE '' END"


def lookup(table: dict, key: str, default) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in table.items()) + f" ELSE {quote(default)} END"


def integer(text: str, low: int, high: int, signed: bool = False) -> str:
    sign = "[+-]?" if signed else "[+]?"
    return f"CASE WHEN regexp_full_match({text}, '{sign}[0-9]+') AND try_cast({text} AS HUGEINT) BETWEEN {low} AND {high} THEN CAST({text} AS BIGINT) END"


EV = f"""WITH ev AS (
  SELECT event_id, ts, user_id, event_type, event_id % 720 AS k, ((event_id % 720) * 31) % 97 AS f,
         'data/d' || ((event_id % 720) % 7) || '/f' || (((event_id % 720) * 31) % 97) ||
         {_list(['.jpg', '.JPEG', '.png', '.webp', '.svg', '.pdf', '.docx', '.gif', '.tiff', '.txt', '', '.tar.png'])}[((event_id % 720) * 31) % 97 % 12 + 1] AS path
  FROM events)"""

REQUESTS = EV + f""", requests AS (
  SELECT event_id AS req_id, ts, user_id AS client, path,
    CASE k % 6 WHEN 0 THEN 'w=320' WHEN 1 THEN 'w=160&dpr=2' WHEN 2 THEN 'h=200&w=' ELSE 'w=' || (1 + (k * 37) % 4000) END
    || {_case('k % 5', ['&rot=left', '&rot=180', '&rot=sideways'])}
    || {_case('k % 11', ['&bg=white', '&bg=12,34,56', '&bg=1234567f', '&bg=%23ffffff', '&bg=12,34'])}
    || {_case('k % 7', ['&f=png', '&f=jpeg', '&f=pdf', '&f=bogus'])}
    || {_case('k % 9', ['&thumb=p:3', '&thumb=p:0,p:x', '&crop=video,100,0,top,5', '&crop=free,10', '&q=50', '&q=999'])}
    || {_case('k % 13', ['&original=true', '&original=yes'])} AS query,
    {_list(['image/avif,image/webp,*/*', 'image/webp,*/*', '*/*', None])}[k % 4 + 1] AS accept
  FROM ev WHERE event_type <> 'purchase')"""

CHANGES = """changes AS (SELECT event_id AS change_id, path, ts AS changed_at FROM ev WHERE event_type = 'purchase')"""

ASSETS = """assets AS (
  SELECT path, CAST(200 + (f * 977) % 20000 AS INTEGER) AS width, CAST(100 + (f * 577) % 9000 AS INTEGER) AS height, f % 2 = 0 AS has_alpha,
         CAST(1 + f % 5 AS INTEGER) AS n_pages, 1000 + f * 7919 AS length, TIMESTAMP '2024-01-01' + to_days(CAST(f % 20 AS INTEGER)) AS modified_at, CAST(CASE WHEN f % 12 < 2 THEN 1 + f % 8 ELSE 1 END AS INTEGER) AS orientation
  FROM (SELECT DISTINCT path, f FROM ev WHERE f % 10 <> 3))"""


def param(name: str) -> str:
    """The decoded value of the last parameter of that name."""
    return f"url_decode(replace(substr(list_filter(string_split(query, '&'), lambda p: starts_with(p, '{name}='))[-1], {len(name) + 2}), '+', ' '))"


def scaled(side: str) -> str:
    product = f"CAST(CAST({side} AS FLOAT) * CAST(coalesce(dpr, 1.0) AS FLOAT) AS DOUBLE)"
    return f"CASE WHEN {side} IS NOT NULL THEN least(65535, CAST(floor(CASE WHEN isnan({product}) OR {product} <= 0 THEN 0.0 WHEN {product} >= 65535 THEN 65535.0 ELSE {product} + 0.5 END) AS BIGINT)) END"


def background(bg: str) -> str:
    """r, g, b and a in a struct."""
    parts = f"string_split({bg}, ',')"
    n = [integer(f"{parts}[{i}]", 0, 255) for i in (1, 2, 3, 4)]
    hex_byte = lambda i: f"CAST('0x' || replace(substr({bg}, {2 * i + 1}, 2), '+', '0') AS INTEGER)"
    s = lambda r, g, b, a: "{'r': CAST(%s AS INTEGER), 'g': CAST(%s AS INTEGER), 'b': CAST(%s AS INTEGER), 'a': CAST(%s AS INTEGER)}" % (r, g, b, a)  # noqa: E731, UP031
    named = " ".join(f"WHEN {bg} = '{k}' THEN {s(*v)}" for k, v in COLOURS.items())
    return f"""CASE {named}
      WHEN contains({bg}, ',') THEN CASE WHEN ({n[0]}) IS NOT NULL AND ({n[1]}) IS NOT NULL AND ({n[2]}) IS NOT NULL
           AND (len({parts}) = 3 OR (len({parts}) = 4 AND ({n[3]}) IS NOT NULL)) THEN {s(n[0], n[1], n[2], f"CASE WHEN len({parts}) = 4 THEN {n[3]} ELSE 255 END")} END
      WHEN regexp_full_match({bg}, '([0-9a-fA-F+][0-9a-fA-F]){{3,4}}') THEN {s(hex_byte(0), hex_byte(1), hex_byte(2), f"CASE WHEN length({bg}) = 8 THEN {hex_byte(3)} ELSE 255 END")} END"""


def crop(c: str) -> str:
    """The crop struct, flat."""
    at = lambda i: f"string_split({c}, ',')[{i + 1}]"
    rw, rh = (integer(f"string_split({at(0)}, ':')[{i}]", 0, 255) for i in (1, 2))
    w, h = (f"nullif({integer(at(i), 0, 65535)}, 0)" for i in (1, 2))
    named = f"{at(0)} IN ('video', 'square', 'free')"
    known = f"{c} IS NOT NULL AND ({named} OR (({rw}) IS NOT NULL AND ({rh}) IS NOT NULL)) AND ({at(0)} <> 'free' OR (({w}) IS NOT NULL AND ({h}) IS NOT NULL))"
    offset = lambda i: f"coalesce({integer(at(i), -32768, 32767, True)}, 0)"
    return f"""CASE WHEN {known} THEN {{'kind': CASE WHEN {named} THEN {at(0)} ELSE 'custom' END, 'rw': CASE WHEN NOT {named} THEN {rw} END, 'rh': CASE WHEN NOT {named} THEN {rh} END,
      'width': {w}, 'height': {h}, 'gravity': {lookup(ORIGINS, at(3), 'center')}, 'dx': {offset(4)}, 'dy': {offset(5)}}} END"""


def thumb(t: str) -> str:
    last = f"list_filter(string_split({t}, ','), lambda p: string_split(p, ':')[1] = 'p')[-1]"
    return f"greatest(coalesce({integer(f'string_split({last}, chr(58))[-1]', 0, 4294967295)}, 1), 1)"


RAW = REQUESTS + f""", texts AS (
  SELECT *, {', '.join(f'{param(n)} AS {n}_t' for n in ('w', 'h', 'q', 'dpr', 'original', 'crop', 'thumb', 'rot', 'bg', 'f', 'token'))} FROM requests
), raw AS (
  SELECT *, {integer('w_t', 0, 65535)} AS w, {integer('h_t', 0, 65535)} AS h, {integer('q_t', 0, 255)} AS q,
         CASE WHEN regexp_full_match(dpr_t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(dpr_t AS FLOAT) END AS dpr,
         CASE original_t WHEN 'true' THEN true WHEN 'false' THEN false END AS original
  FROM texts
), typed AS (
  SELECT *, (w_t IS NOT NULL AND w IS NULL) OR (h_t IS NOT NULL AND h IS NULL) OR (q_t IS NOT NULL AND q IS NULL)
            OR (dpr_t IS NOT NULL AND dpr IS NULL) OR (original_t IS NOT NULL AND original IS NULL) AS bad FROM raw
), spec AS (
  SELECT req_id, ts, client, path, query, accept, bad, token_t, {scaled('w')} AS width, {scaled('h')} AS height, q AS quality, {crop('crop_t')} AS crop, {thumb('thumb_t')} AS page,
         coalesce(original, false) AS original, {lookup(ROTATIONS, 'rot_t', 0)} AS rotate, {background('bg_t')} AS background, {lookup(FORMATS, 'f_t', 'auto')} AS format
  FROM typed
)"""

NAME = "regexp_extract(path, '[^/]*$')"
EXT = f"nullif(lower(regexp_extract({NAME}, '^.+\\.([^.]*)$', 1)), '')"
STEM = f"coalesce(nullif(regexp_extract({NAME}, '^(.+)\\.[^.]*$', 1), ''), {NAME})"


def any_of(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


CANONICAL = """concat_ws('|', coalesce(CAST(width AS VARCHAR), '-'), coalesce(CAST(height AS VARCHAR), '-'), coalesce(CAST(quality AS VARCHAR), '-'),
  CASE WHEN crop IS NULL THEN '-' ELSE concat_ws(',', crop.kind, coalesce(CAST(crop.rw AS VARCHAR), '-'), coalesce(CAST(crop.rh AS VARCHAR), '-'), coalesce(CAST(crop.width AS VARCHAR), '-'),
    coalesce(CAST(crop.height AS VARCHAR), '-'), crop.gravity, CAST(crop.dx AS VARCHAR), CAST(crop.dy AS VARCHAR)) END,
  CAST(page AS VARCHAR), CASE WHEN original THEN 'true' ELSE 'false' END, CAST(rotate AS VARCHAR),
  CASE WHEN background IS NULL THEN '-' ELSE concat_ws(',', CAST(background.r AS VARCHAR), CAST(background.g AS VARCHAR), CAST(background.b AS VARCHAR), CAST(background.a AS VARCHAR)) END, format)"""


def key_of(fmt: str) -> str:
    return f"substr(spec_hash, 1, 2) || '/' || substr(spec_hash, 3, 2) || '/' || substr(spec_hash, 5, 2) || '/' || spec_hash || '-' || sha256(path) || '.' || {fmt}"


def u16(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN 0 WHEN {x} >= 65535 THEN 65535 ELSE CAST(floor({x} + 0.5) AS BIGINT) END"


def target(w: str, h: str, sw: str = "sw", sh: str = "sh") -> tuple[str, str]:
    """Sides of target_dims over the source's columns."""
    ratio = f"(CAST({sw} AS DOUBLE) / CAST({sh} AS DOUBLE))"
    first = f"CASE WHEN ({w}) IS NULL AND ({h}) IS NULL THEN {sw} % 65536 ELSE ({w}) END"
    out_w = f"coalesce({first}, {u16(f'(CAST(({h}) AS DOUBLE) * {ratio})')})"
    return out_w, f"coalesce(({h}), {u16(f'(CAST({out_w} AS DOUBLE) / {ratio})')})"


TURNED = ("CASE WHEN rotate IN (90, 270) THEN height ELSE width END", "CASE WHEN rotate IN (90, 270) THEN width ELSE height END")
PW, PH = target(*TURNED)
LPW, LPH = target(*TURNED, "lw", "lh")
TW, TH = target("width", "height")


def shrink(w: str, h: str, pw: str, ph: str) -> str:
    return f"greatest(1.0, least(CAST({w} AS DOUBLE) / nullif({pw}, 0), CAST({h} AS DOUBLE) / nullif({ph}, 0)))"


def covered(w: str, h: str, pw: str, ph: str) -> tuple[str, str]:
    """Sides of output_dims before the turn."""
    by = shrink(w, h, pw, ph)
    none = "width IS NULL AND height IS NULL"
    return tuple(f"CASE WHEN {none} THEN {side} ELSE least({box}, CAST(floor({side} / {by} + 0.5) AS BIGINT)) END" for side, box in ((w, pw), (h, ph)))


def planned_sql(avif: bool) -> str:
    """Requests with format, sizes and keys. Sizes are taken upright; svg, pdf and documents are loaded
    at the size that the request needs."""
    accepts_avif = "WHEN contains(accept, 'image/avif') THEN 'avif' " if avif else ""
    own_w, own_h = covered("sw", "sh", "pw", "ph")
    load_w, load_h = covered("lw", "lh", "lpw", "lph")
    loads = f"ext IN {any_of(['svg', 'pdf', *DOCUMENTS])}"
    return RAW + ", " + CHANGES + ", " + ASSETS + f""", hashed AS (
  SELECT *, sha256(path || '|' || {CANONICAL}) AS spec_hash, coalesce({EXT}, '') AS ext FROM spec
), attached AS (
  SELECT s.*, CASE WHEN a.orientation BETWEEN 5 AND 8 THEN a.height ELSE a.width END AS sw, CASE WHEN a.orientation BETWEEN 5 AND 8 THEN a.width ELSE a.height END AS sh,
    a.has_alpha, a.n_pages, a.modified_at, a.path IS NOT NULL AS found FROM hashed s LEFT JOIN assets a ON s.path = a.path
), sized AS (
  SELECT *, {PW} AS pw, {PH} AS ph, {TW} AS tw, {TH} AS th,
    CASE WHEN format <> 'auto' THEN format WHEN accept IS NULL THEN 'webp' {accepts_avif}WHEN contains(accept, 'image/webp') THEN 'webp' ELSE 'jpg' END AS negotiated
  FROM attached
), loads AS (
  SELECT *, {own_w} AS own_w, {own_h} AS own_h,
    CASE WHEN NOT {loads} THEN sw WHEN rotate NOT IN (90, 270) THEN tw WHEN tw > th THEN th + 2 ELSE CAST(floor(sw * (CAST(tw AS DOUBLE) / sh) + 0.5) AS BIGINT) END AS lw,
    CASE WHEN NOT {loads} THEN sh WHEN rotate NOT IN (90, 270) THEN th WHEN tw > th THEN CAST(floor(sh * (CAST(tw AS DOUBLE) / sh) + 0.5) AS BIGINT) ELSE tw + 2 END AS lh
  FROM sized
), boxes AS (
  SELECT *, {LPW} AS lpw, {LPH} AS lph FROM loads
), limits AS (
  SELECT *, coalesce((negotiated = 'webp' AND (lw > 16383 OR lh > 16383 OR CAST(lw AS BIGINT) * lh > 170000000)) OR (negotiated IN ('avif', 'png') AND (lw > 16384 OR lh > 16384)), false) AS too_large,
    {load_w} AS bw, {load_h} AS bh
  FROM boxes
), planned AS (
  SELECT *, CASE WHEN NOT too_large THEN negotiated WHEN format <> 'auto' THEN NULL WHEN negotiated = 'webp' AND has_alpha AND lw <= 16384 AND lh <= 16384 THEN 'png' ELSE 'jpg' END AS output_format,
    CASE WHEN too_large AND format <> 'auto' THEN 'too_large' END AS limit_error,
    CASE WHEN rotate IN (90, 270) THEN bh ELSE bw END AS ow, CASE WHEN rotate IN (90, 270) THEN bw ELSE bh END AS oh, {key_of('negotiated')} AS first_key
  FROM limits
), keyed AS (
  SELECT *, {key_of('coalesce(output_format, negotiated)')} AS cache_key, ext IN {any_of(DOCUMENTS)} AS convertible, ext IN {any_of([*RASTER, *DOCUMENTS, 'pdf'])} AS supported,
    CASE WHEN negotiated = 'pdf' AND ext NOT IN {any_of(DOCUMENTS)} THEN 'pdf_not_available' WHEN width = 0 OR height = 0 THEN 'invalid_dimension' ELSE limit_error END AS plan_error
  FROM planned
)"""


PLANNED = planned_sql(False)

#: Entries that the fixture cache holds: the first request of every path and query, for ids divisible by 3.
VARIANTS = """, variants AS (
  SELECT cache_key, path, output_format, 1000 + req_id % 5000 AS length, ts AS cached_at FROM (
    SELECT *, row_number() OVER (PARTITION BY path, query ORDER BY req_id) AS nth FROM keyed WHERE req_id % 3 = 0) WHERE nth = 1
), documents_cache AS (
  SELECT DISTINCT path, TIMESTAMP '2024-01-10' AS cached_at FROM ev WHERE f % 2 = 0 AND ends_with(path, '.docx')
), cache_index AS (
  SELECT path, min(regexp_extract(cache_key, '([^/]*)\\.[^./]*$', 1)) AS stem, min(cached_at) AS written_at FROM variants GROUP BY path
)"""


def routed_sql(avif: bool = False, auth: str = "'ok'") -> str:
    """``routed``: requests with their outcome; ``auth`` is SQL for the state of a request's token."""
    return planned_sql(avif) + VARIANTS + f""", entries AS (SELECT cache_key, max(cached_at) AS cached_at FROM variants GROUP BY cache_key),
docs AS (SELECT path, max(cached_at) AS converted_at FROM documents_cache GROUP BY path),
looked AS (
  SELECT k.*, CASE WHEN e1.cached_at IS NULL THEN 'absent' WHEN date_trunc('second', e1.cached_at) < date_trunc('second', modified_at) THEN 'stale' ELSE 'hit' END AS first_state,
    CASE WHEN e2.cached_at IS NULL THEN 'absent' WHEN date_trunc('second', e2.cached_at) < date_trunc('second', modified_at) THEN 'stale' ELSE 'hit' END AS cache_state,
    convertible AND NOT (d.converted_at IS NOT NULL AND coalesce(date_trunc('second', d.converted_at) >= date_trunc('second', modified_at), true)) AS converting
  FROM keyed k LEFT JOIN entries e1 ON k.first_key = e1.cache_key LEFT JOIN entries e2 ON k.cache_key = e2.cache_key LEFT JOIN docs d ON k.path = d.path
), routed AS (
  SELECT *, CASE WHEN bad THEN 'bad_request' WHEN {auth} <> 'ok' THEN 'forbidden' WHEN NOT found THEN 'not_found' WHEN original OR NOT supported THEN 'original'
    WHEN NOT converting AND (first_state = 'hit' OR (plan_error IS NULL AND cache_state = 'hit')) THEN 'cached' WHEN plan_error IS NOT NULL THEN 'error' ELSE 'render' END AS outcome
  FROM looked
)"""


ROUTED = routed_sql()

"""DuckDB SQL for every catalogued query (the correctness oracle).

Written independently of the Spark code: bounds, buckets, tokens, vocabulary, indexing
and windows are all restated in SQL with window functions and list aggregates.
"""

from __future__ import annotations

W_PAST = "((d % 7) - 3) * CAST(0.05 AS DOUBLE)"
B_PAST = "(t % 5) * CAST(0.01 AS DOUBLE)"
W_FUTURE = "((d % 5) - 2) * CAST(0.04 AS DOUBLE)"
B_FUTURE = "(t % 3) * CAST(0.02 AS DOUBLE)"


def events_ctes() -> str:
    """CTEs: ``ev_n`` (bounds), ``rec`` (pos, event_id, answer, tokens), ``toks``,
    ``freq``, ``vocab``, ``idx`` (pos, event_id, answer, ids, feat)."""
    return """
ev_b AS (SELECT min(value) AS mn, max(value) AS mx, stddev_samp(value) AS sd FROM events),
ev_n AS (SELECT mn, sd, CASE WHEN sd IS NULL OR sd = 0 THEN 1
                             ELSE CAST(floor((mx - mn) / sd) AS BIGINT) END AS n FROM ev_b),
rec AS (
  SELECT CAST(row_number() OVER (ORDER BY e.event_id) - 1 AS BIGINT) AS pos,
         e.event_id, e.event_type AS answer,
         [coalesce(CAST(CASE WHEN e.value IS NULL THEN NULL
                             WHEN ev_n.sd IS NULL OR ev_n.sd = 0 THEN 0
                             ELSE CAST(least(greatest(floor((e.value - ev_n.mn) / ev_n.sd), 0), ev_n.n - 1) AS INTEGER)
                        END AS VARCHAR), 'None') || 'value_bucketized',
          coalesce(CAST(e.value AS VARCHAR), 'None') || 'value',
          coalesce(e.props, 'None') || 'props',
          coalesce(CAST(e.user_id AS VARCHAR), 'None') || 'user_id',
          coalesce(e.event_type, 'None')] AS tokens
  FROM events e CROSS JOIN ev_n),
toks AS (SELECT pos, unnest(tokens) AS token, unnest(range(len(tokens))) AS token_pos FROM rec),
freq AS (SELECT token, count(*) AS freq FROM toks GROUP BY token),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token) + 1 AS BIGINT) AS token_id, freq
          FROM freq),
idx0 AS (SELECT t.pos, list(coalesce(v.token_id, 1) ORDER BY t.token_pos) AS ids
         FROM toks t LEFT JOIN vocab v ON v.token = t.token GROUP BY t.pos),
idx AS (SELECT r.pos, r.event_id, r.answer, r.tokens, i.ids, i.ids[1:4] AS feat,
               CASE WHEN r.answer = 'error' THEN 1 ELSE 0 END AS label
        FROM rec r JOIN idx0 i ON i.pos = r.pos)"""


def with_events(body: str) -> str:
    return "WITH " + events_ctes() + "\n" + body


def window_sql(n: int, width: int | None, partition: str = "", order: str = "pos",
               value: str = "feat", pad: str = "0") -> str:
    """Padded window text: flattened history of the last n values, comma-joined."""
    part = f"PARTITION BY {partition} " if partition else ""
    frame = f"OVER ({part}ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    if width is None:
        padding = f"repeat('{pad},', {n} - len(list({value}) {frame}))"
        return f"{padding} || array_to_string(list({value}) {frame}, ',')"
    unit = ",".join([pad] * width) + ","
    padding = f"repeat('{unit}', {n} - len(list({value}) {frame}))"
    return f"{padding} || array_to_string(flatten(list({value}) {frame}), ',')"


def _bounds_select(table: str, col: str) -> str:
    x = f"CAST({col} AS DOUBLE)"
    sd = f"stddev_samp({x})"
    return (
        f"SELECT '{table}.{col}' AS column_name, min({x}) AS min_value, max({x}) AS max_value, "
        f"round({sd}, 6) AS stddev, CASE WHEN {sd} IS NULL OR {sd} = 0 THEN 1 "
        f"ELSE CAST(floor((max({x}) - min({x})) / {sd}) AS BIGINT) END AS n_buckets FROM {table}"
    )


BOUNDS_COLUMNS = (
    ("events", "value"), ("lineitem", "l_quantity"), ("lineitem", "l_discount"),
    ("lineitem", "l_tax"), ("orders", "o_totalprice"), ("customer", "c_acctbal"),
    ("part", "p_size"),
)


def _stddev_bucket(col: str, b: str) -> str:
    return (f"CASE WHEN {col} IS NULL THEN NULL WHEN {b}.sd IS NULL OR {b}.sd = 0 THEN 0 "
            f"ELSE CAST(least(greatest(floor(({col} - {b}.mn) / {b}.sd), 0), {b}.n - 1) AS INTEGER) END")


def _bn(name: str, table: str, col: str) -> str:
    return (f"{name} AS (SELECT min({col}) AS mn, stddev_samp({col}) AS sd, "
            f"CASE WHEN stddev_samp({col}) IS NULL OR stddev_samp({col}) = 0 THEN 1 "
            f"ELSE CAST(floor((max({col}) - min({col})) / stddev_samp({col})) AS BIGINT) END AS n FROM {table})")


def _scores_sql() -> str:
    label = "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events"
    return f"""
scores AS (
  SELECT 'm_value' AS model_id, least(value / 100.0, 1.0) AS score, {label}
  UNION ALL
  SELECT 'm_inverse', 1.0 - least(value / 500.0, 1.0), {label}
  UNION ALL
  SELECT 'm_props', CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100.0, {label})"""


def _pr_sql(scores: str, group: str) -> str:
    g = f"{group}, " if group else ""
    return f"""
th AS (SELECT CASE WHEN i = 10 THEN CAST(1.0 AS DOUBLE) ELSE i * CAST(0.1 AS DOUBLE) END AS threshold
       FROM range(11) r(i)),
cnt AS (SELECT {g}th.threshold,
               CAST(sum(CASE WHEN s.score > th.threshold AND s.label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
               CAST(sum(CASE WHEN s.score > th.threshold AND s.label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
               CAST(sum(CASE WHEN NOT (s.score > th.threshold) AND s.label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
        FROM {scores} s CROSS JOIN th GROUP BY {g}th.threshold)
SELECT {g}threshold, tp, fp, fn,
       round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1
FROM cnt"""


def _attention_steps() -> str:
    return """
st AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS x,
              CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS t
       FROM embeddings)"""


def _pool_sql(src: str, step: str, w: str, b: str, name: str) -> str:
    """CTEs ``{name}_a`` (label, vec_id, step, a) and ``{name}`` (label, dim, pooled)."""
    return f"""
{name}_a AS (SELECT label, vec_id, x, {step} AS s,
                    exp(tanh(list_sum(list_transform(range(64), lambda d: x[d + 1] * ({w}))) + {b})) AS a
             FROM {src}),
{name}_z AS (SELECT label, sum(a) AS z FROM {name}_a GROUP BY label),
{name}_c AS (SELECT label, a, unnest(x) AS xv, unnest(range(64)) AS dim FROM {name}_a),
{name} AS (SELECT c.label, CAST(c.dim AS INTEGER) AS dim, sum(c.a * c.xv) / (z.z + 1e-7) AS pooled
           FROM {name}_c c JOIN {name}_z z ON z.label = c.label GROUP BY c.label, c.dim, z.z)"""


BAYES_GRID = (("alpha_0.1", "0.1"), ("alpha_1", "1.0"), ("alpha_10", "10.0"))


def _bayes_ctes() -> str:
    """``bs``: (model_id, event_id, label, score) of every event's window of 5."""
    grid = ", ".join(f"('{m}', CAST({a} AS DOUBLE))" for m, a in BAYES_GRID)
    return f""",
wt AS (SELECT r.pos, r.event_id, CASE WHEN r.answer = 'error' THEN 1 ELSE 0 END AS label,
              CAST(s.i AS VARCHAR) || '|' || coalesce(t.token, '<pad>') AS term
       FROM rec r CROSS JOIN range(5) s(i) CROSS JOIN range(4) k(i)
       LEFT JOIN toks t ON t.pos = r.pos - 4 + s.i AND t.token_pos = k.i),
tw AS (SELECT term, label, CASE WHEN label = 0 THEN 10.0 ELSE 0.2 END::DOUBLE AS w FROM wt WHERE pos // 1000 < 8),
tc AS (SELECT term, coalesce(sum(w) FILTER (WHERE label = 0), 0) AS w0,
              coalesce(sum(w) FILTER (WHERE label = 1), 0) AS w1 FROM tw GROUP BY term),
tt AS (SELECT sum(w0) AS s0, sum(w1) AS s1, count(*) AS v FROM tc),
pr AS (SELECT coalesce(sum(CAST(10.0 AS DOUBLE)) FILTER (WHERE answer <> 'error'), 0) AS p0,
              coalesce(sum(CAST(0.2 AS DOUBLE)) FILTER (WHERE answer = 'error'), 0) AS p1
       FROM rec WHERE pos // 1000 < 8),
grid(model_id, a) AS (VALUES {grid}),
bz AS (SELECT g.model_id, wt.event_id, wt.label,
              sum(ln((coalesce(tc.w1, 0) + g.a) / (tt.s1 + g.a * (tt.v + 1)))
                  - ln((coalesce(tc.w0, 0) + g.a) / (tt.s0 + g.a * (tt.v + 1))))
              + any_value(ln((pr.p1 + g.a) / (pr.p0 + g.a))) AS z
       FROM wt LEFT JOIN tc ON tc.term = wt.term CROSS JOIN tt CROSS JOIN pr CROSS JOIN grid g
       GROUP BY g.model_id, wt.event_id, wt.label),
bs AS (SELECT model_id, event_id, label, 1 / (1 + exp(-z)) AS score FROM bz)"""


def _wide_sql() -> str:
    """The 42-field flow: lines, tokens, vocabulary, windows of 5 records."""
    from seqtok.config import KDD_COLUMNS, WIDE_FIELDS, kdd_spec

    spec = kdd_spec()
    fields = ", ".join(f"{e} AS f_{c}" for c, e in zip(KDD_COLUMNS, WIDE_FIELDS))
    bounds = ", ".join(
        f"min(CAST(f_{c} AS DOUBLE)) AS mn_{c}, stddev_samp(CAST(f_{c} AS DOUBLE)) AS sd_{c}, "
        f"max(CAST(f_{c} AS DOUBLE)) AS mx_{c}" for c in spec.bucket_columns)
    tokens = []
    for f in spec.features:
        x = f"CAST(f_{f.column} AS DOUBLE)"
        if f.kind == "bucket":
            c = f.column
            n = f"CASE WHEN sd_{c} IS NULL OR sd_{c} = 0 THEN 1 ELSE floor((mx_{c} - mn_{c}) / sd_{c}) END"
            b = (f"CASE WHEN sd_{c} IS NULL OR sd_{c} = 0 THEN 0 "
                 f"ELSE CAST(greatest(least(floor(({x} - mn_{c}) / sd_{c}), {n} - 1), 0) AS INTEGER) END")
            tokens.append(f"CAST({b} AS VARCHAR) || '{f.token_suffix}'")
        elif f.column in spec.bucket_columns:
            tokens.append(f"f_{f.column} || '.0' || '{f.token_suffix}'")
        else:
            tokens.append(f"f_{f.column} || '{f.token_suffix}'")
    tokens.append("f_answer")
    n = spec.n_features
    frame = "OVER (ORDER BY r.pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    pad = ",".join(["0"] * n) + ","
    return f"""
WITH lines AS (
  SELECT *, md5(concat_ws(',', {", ".join("f_" + c for c in KDD_COLUMNS)})) AS line_md5
  FROM (SELECT l_orderkey, l_linenumber, {fields}
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)),
b AS (SELECT {bounds} FROM lines),
rec AS (SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, line_md5) - 1 AS BIGINT) AS pos,
               l_orderkey, l_linenumber, line_md5, f_answer AS answer, [{", ".join(tokens)}] AS tokens
        FROM lines CROSS JOIN b),
toks AS (SELECT pos, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM rec),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS BIGINT) AS id
          FROM toks GROUP BY token),
idx AS (SELECT t.pos, list(v.id ORDER BY t.i)[1:{n}] AS feat FROM toks t JOIN vocab v USING (token) GROUP BY t.pos),
w AS (SELECT r.*, list(i.feat) {frame} AS h,
             list(CASE WHEN r.answer = 'R' THEN 0 ELSE 1 END) {frame} AS y
      FROM rec r JOIN idx i ON i.pos = r.pos)
SELECT l_orderkey, l_linenumber, line_md5,
       md5(repeat('{pad}', CAST(5 - len(h) AS BIGINT)) || array_to_string(flatten(h), ',')) AS window_md5,
       CAST({5 * n} AS INTEGER) AS n_ids,
       repeat('0,', CAST(5 - len(y) AS BIGINT)) || array_to_string(y, ',') AS labels
FROM w"""


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}

    q["column_bounds"] = "\nUNION ALL\n".join(_bounds_select(t, c) for t, c in BOUNDS_COLUMNS)

    q["bucketize_unit"] = """
WITH b AS (SELECT CASE WHEN stddev_samp(value) IS NULL OR stddev_samp(value) = 0 THEN 1
                  ELSE CAST(floor((max(value) - min(value)) / stddev_samp(value)) AS BIGINT) END AS n
           FROM events)
SELECT e.event_id, e.value,
       CAST(CASE WHEN e.value IS NULL THEN NULL
                 ELSE least(greatest(floor(least(greatest(e.value, -1.0), b.n)) + 1, 0), b.n) END AS INTEGER) AS bucket
FROM events e CROSS JOIN b"""

    q["bucketize_stddev"] = (
        "WITH " + ", ".join([_bn("bq", "lineitem", "l_quantity"), _bn("bd", "lineitem", "l_discount"),
                            _bn("bt", "lineitem", "l_tax")]) + f"""
SELECT l.l_orderkey, l.l_linenumber, l.l_quantity,
       {_stddev_bucket('l.l_quantity', 'bq')} AS quantity_bucket,
       {_stddev_bucket('l.l_discount', 'bd')} AS discount_bucket,
       {_stddev_bucket('l.l_tax', 'bt')} AS tax_bucket
FROM lineitem l CROSS JOIN bq CROSS JOIN bd CROSS JOIN bt""")

    q["encode_tokens"] = with_events("""
SELECT event_id, tokens[1] AS tok_value_bucket, tokens[2] AS tok_value, tokens[3] AS tok_props,
       tokens[4] AS tok_user_id, tokens[5] AS tok_answer FROM rec""")

    q["record_sentence"] = with_events("""
SELECT event_id, array_to_string(tokens, ',') AS sentence, CAST(len(tokens) AS INTEGER) AS n_tokens FROM rec""")

    q["text_record_split"] = """
WITH lines AS (SELECT concat_ws(',', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), event_type,
                                CAST(value AS VARCHAR), props) AS line FROM events)
SELECT string_split(line, ',')[1] AS f_event_id, string_split(line, ',')[2] AS f_user_id,
       string_split(line, ',')[3] AS f_event_type, string_split(line, ',')[4] AS f_value,
       string_split(line, ',')[5] AS f_props FROM lines"""

    q["text_record_order"] = """
SELECT CAST(event_id AS VARCHAR) AS f_event_id, CAST(value AS VARCHAR) AS f_value,
       CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS pos FROM events"""

    q["token_frequencies"] = with_events("SELECT token, freq FROM freq")

    q["doc_token_frequencies"] = """
SELECT token, count(*) AS freq FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents)
GROUP BY token"""

    q["distinct_tokens"] = with_events("SELECT DISTINCT token FROM toks")

    q["top_tokens"] = """
SELECT token, count(*) AS freq FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents)
GROUP BY token ORDER BY freq DESC, token LIMIT 100"""

    q["first_n"] = """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey, o_custkey LIMIT 100"""

    q["vocabulary"] = with_events("SELECT token, token_id, freq FROM vocab")

    q["index_tokens"] = with_events(
        "SELECT event_id, array_to_string(ids, ',') AS token_ids FROM idx")
    q["index_tokens_salted"] = q["index_tokens"]

    q["oov_replace"] = with_events(""",
n_all AS (SELECT count(*) AS n FROM rec),
train_toks AS (SELECT t.token FROM toks t WHERE t.pos < (SELECT n FROM n_all) * 8 // 10),
tv AS (SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS BIGINT) AS token_id
       FROM train_toks GROUP BY token),
j AS (SELECT t.pos, t.token_pos, CASE WHEN v.token_id IS NULL THEN 'unknown' ELSE t.token END AS seen,
             coalesce(v.token_id, 1) AS tid
      FROM toks t LEFT JOIN tv v ON v.token = t.token)
SELECT r.event_id, array_to_string(list(j.seen ORDER BY j.token_pos), ',') AS tokens_seen,
       array_to_string(list(j.tid ORDER BY j.token_pos), ',') AS token_ids
FROM j JOIN rec r ON r.pos = j.pos GROUP BY r.event_id""")

    q["mask_tokens"] = with_events(""",
d AS (SELECT pos, event_id, tokens, ids,
             CAST(CAST(('0x' || substr(md5('42/' || CAST(pos AS VARCHAR)), 9, 8)) AS BIGINT) % 4 AS INTEGER) AS mask_pos,
             CAST(('0x' || substr(md5('42/' || CAST(pos AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u
      FROM idx),
m AS (SELECT d.*, coalesce(d.u > 1.0 / f.freq, false) AS masked
      FROM d LEFT JOIN freq f ON f.token = d.tokens[d.mask_pos + 1])
SELECT event_id, mask_pos, masked,
       array_to_string(list_transform(ids, lambda x, i: CASE WHEN i = mask_pos + 1 AND masked THEN 1 ELSE x END), ',')
         AS token_ids
FROM m""")

    q["binary_label"] = """
SELECT event_id, event_type AS answer, CAST(CASE WHEN event_type IN ('error') THEN 1 ELSE 0 END AS INTEGER) AS label
FROM events"""

    q["global_position"] = """
SELECT event_id, CAST(row_number() OVER (ORDER BY value, event_id) - 1 AS BIGINT) AS pos FROM events"""

    q["global_position_ranges"] = q["global_position"]

    q["sequence_window_global"] = with_events(
        f"SELECT event_id, {window_sql(40, 4)} AS window FROM idx")

    q["sequence_window_keyed"] = with_events(
        "SELECT i.event_id, e.user_id, "
        + window_sql(40, 4, partition="e.user_id", order="i.event_id", value="i.feat")
        + " AS window FROM idx i JOIN events e ON e.event_id = i.event_id")

    q["label_window"] = with_events(
        f"SELECT event_id, {window_sql(40, None, value='label')} AS labels FROM idx")

    q["past_future_split"] = with_events(""",
w AS (SELECT event_id,
             list_concat(list_transform(range(51 - len(list(feat) OVER (ORDER BY pos ROWS BETWEEN 50 PRECEDING AND CURRENT ROW))),
                                        lambda k: [0, 0, 0, 0]::BIGINT[]),
                         list(feat) OVER (ORDER BY pos ROWS BETWEEN 50 PRECEDING AND CURRENT ROW)) AS steps
      FROM idx)
SELECT event_id, array_to_string(flatten(list_reverse(steps[1:26])), ',') AS past,
       array_to_string(flatten(steps[26:51]), ',') AS future FROM w""")

    q["chunk_assign"] = """
WITH p AS (SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS pos FROM events)
SELECT event_id, pos, CAST(pos // 1000 AS BIGINT) AS chunk_id, CAST(pos % 1000 AS BIGINT) AS row_in_chunk FROM p"""

    q["chunk_by_key"] = """
WITH r AS (SELECT event_id, user_id,
                  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rk FROM events),
c AS (SELECT event_id, user_id, rk, rk // 20 AS ck FROM r)
SELECT event_id, user_id, CAST(dense_rank() OVER (ORDER BY user_id, ck) - 1 AS BIGINT) AS chunk_id,
       CAST(rk - ck * 20 AS BIGINT) AS row_in_chunk FROM c"""

    q["chunk_by_file"] = """
WITH r AS (SELECT event_id, event_id // 2500 AS f,
                  row_number() OVER (PARTITION BY event_id // 2500 ORDER BY event_id) - 1 AS rk FROM events),
c AS (SELECT event_id, f, rk, rk // 1000 AS ck FROM r)
SELECT CAST(event_id AS VARCHAR) AS f_event_id, CAST(dense_rank() OVER (ORDER BY f, ck) - 1 AS BIGINT) AS chunk_id,
       CAST(rk - ck * 1000 AS BIGINT) AS row_in_chunk FROM c"""

    q["batch_assign"] = """
WITH p AS (SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS pos FROM events)
SELECT event_id, CAST(pos // 1000 AS BIGINT) AS chunk_id, CAST((pos % 1000) // 128 AS BIGINT) AS batch_id FROM p"""

    q["train_validation_split"] = """
WITH p AS (SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) // 1000 AS chunk_id FROM events)
SELECT event_id, CAST(chunk_id AS BIGINT) AS chunk_id,
       CASE WHEN chunk_id < 8 THEN 'train' WHEN chunk_id < 10 THEN 'validation' ELSE 'test' END AS split FROM p"""

    q["rows_per_file"] = "SELECT 'lineitem.parquet' AS file_name, count(*) AS n_rows FROM lineitem"

    q["one_hot"] = """
SELECT vec_id, label,
       array_to_string(list_transform(range(10), lambda c: CASE WHEN c = label THEN 1 ELSE 0 END), ',') AS one_hot
FROM embeddings"""

    q["embed_tokens"] = with_events(""",
u AS (SELECT event_id, unnest(feat) AS tid, unnest(range(4)) AS i FROM idx),
h AS (SELECT u.event_id, u.i, CAST(e.embedding AS DOUBLE[]) AS x FROM u LEFT JOIN embeddings e ON e.vec_id = u.tid),
c AS (SELECT event_id, i, unnest(x) AS xv, unnest(range(64)) AS d FROM h WHERE x IS NOT NULL),
s AS (SELECT event_id, sum(xv) AS vs, sum(xv * (i * 64 + d + 1)) AS vc FROM c GROUP BY event_id),
n AS (SELECT event_id, CAST(count(*) FILTER (WHERE x IS NOT NULL AND list_max(list_transform(x, lambda v: abs(v))) > 0) AS INTEGER) AS n_hits
      FROM h GROUP BY event_id)
SELECT n.event_id, n.n_hits, round(coalesce(s.vs, 0.0), 6) AS vec_sum, round(coalesce(s.vc, 0.0), 6) AS vec_check
FROM n LEFT JOIN s ON s.event_id = n.event_id""")

    q["attention_pool"] = ("WITH " + _attention_steps().strip() + ","
                           + _pool_sql("st", "t", W_PAST, B_PAST, "pool").rstrip()
                           + "\nSELECT label, dim, round(pooled, 6) AS pooled FROM pool")

    q["attention_pool_masked"] = ("WITH " + _attention_steps().strip() + """,
live AS (SELECT * FROM st WHERE x[1] >= 0),"""
                                  + _pool_sql("live", "t", W_PAST, B_PAST, "pool").rstrip()
                                  + "\nSELECT label, dim, round(pooled, 6) AS pooled FROM pool")

    q["attention_weights"] = ("WITH " + _attention_steps().strip() + ","
                              + _pool_sql("st", "t", W_PAST, B_PAST, "pool").rstrip()
                              + """
SELECT a.label, a.vec_id, a.s AS step, round(a.a / (z.z + 1e-7), 6) AS attention
FROM pool_a a JOIN pool_z z ON z.label = a.label""")

    q["past_future_pool"] = ("WITH " + _attention_steps().strip() + """,
past AS (SELECT label, vec_id, x, 25 - t AS t FROM st WHERE t <= 25),
fut AS (SELECT label, vec_id, x, t - 25 AS t FROM st WHERE t >= 25),"""
                             + _pool_sql("past", "t", W_PAST, B_PAST, "pp").rstrip() + ","
                             + _pool_sql("fut", "t", W_FUTURE, B_FUTURE, "fp").rstrip()
                             + """
SELECT label, dim, round(pooled, 6) AS pooled FROM pp
UNION ALL
SELECT label, dim + 64, round(pooled, 6) FROM fp""")

    q["class_weights"] = """
SELECT quality, count(*) AS n,
       round(sum(CASE WHEN quality = 0 THEN CAST(10.0 AS DOUBLE) WHEN quality = 1 THEN CAST(0.2 AS DOUBLE) END), 6) AS weight_sum
FROM labels GROUP BY quality"""

    q["precision_recall_curve"] = ("WITH " + _scores_sql().strip() + ","
                                   + _pr_sql("(SELECT * FROM scores WHERE model_id = 'm_value')", "").rstrip())
    q["metrics_table"] = q["precision_recall_curve"]

    q["compare_models"] = "WITH " + _scores_sql().strip() + "," + _pr_sql("scores", "model_id")

    losses = """
ls AS (SELECT model_id,
              avg(-ln(CASE WHEN label = 1 THEN least(greatest(score, 1e-7), 1 - 1e-7)
                           ELSE 1 - least(greatest(score, 1e-7), 1 - 1e-7) END)) AS log_loss,
              avg(-(CASE WHEN label = 0 THEN 0.7 ELSE 0.3 END)
                  * ln(CASE WHEN label = 1 THEN least(greatest(score, 1e-7), 1 - 1e-7)
                            ELSE 1 - least(greatest(score, 1e-7), 1 - 1e-7) END)) AS weighted_loss,
              avg(CASE WHEN (CASE WHEN score > 0.5 THEN 1 ELSE 0 END) = label THEN 1 ELSE 0 END) AS binary_accuracy,
              count(*) AS n
       FROM scores GROUP BY model_id)"""
    q["model_losses"] = ("WITH " + _scores_sql().strip() + "," + losses + """
SELECT model_id, round(log_loss, 6) AS log_loss, round(weighted_loss, 6) AS weighted_loss,
       round(binary_accuracy, 6) AS binary_accuracy, n FROM ls""")
    q["best_model"] = ("WITH " + _scores_sql().strip() + "," + losses + """
SELECT arg_min(model_id, log_loss) AS model_id, round(min(log_loss), 6) AS log_loss FROM ls""")

    q["align_scores"] = """
SELECT d.doc_id, least(d.n_chars / 5000.0, 1.0) AS score, l.quality AS label
FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""

    q["chunk_round_trip"] = with_events(""",
ch AS (SELECT event_id, CAST(pos // 1000 AS BIGINT) AS chunk_id, label, ids FROM idx)
SELECT event_id, chunk_id,
       CASE WHEN chunk_id < 8 THEN 'train' WHEN chunk_id < 10 THEN 'validation' ELSE 'test' END AS split,
       label, array_to_string(ids, ',') AS token_ids FROM ch""")

    q["sentence_round_trip"] = with_events(""",
o AS (SELECT pos, [' lead', 'trail ', 'say "x"', ''][pos % 4 + 1] AS odd, tokens FROM rec),
t AS (SELECT pos, CASE WHEN pos % 10 = 0 THEN [odd] ELSE list_concat([odd], tokens, [odd]) END AS t FROM o)
SELECT pos, array_to_string(t, ',') AS sentence, CAST(len(t) AS INTEGER) AS n_tokens FROM t""")

    q["vocabulary_round_trip"] = q["vocabulary"]

    q["bayes_scores"] = with_events(_bayes_ctes() + """
SELECT model_id, event_id, CAST(label AS INTEGER) AS label, round(score, 6) AS score FROM bs""")
    q["bayes_best"] = with_events(_bayes_ctes() + """,
bl AS (SELECT model_id, avg(-ln(CASE WHEN label = 1 THEN least(greatest(score, 1e-7), 1 - 1e-7)
                                     ELSE 1 - least(greatest(score, 1e-7), 1 - 1e-7) END)) AS log_loss
       FROM bs GROUP BY model_id)
SELECT arg_min(model_id, log_loss) AS model_id, round(min(log_loss), 6) AS log_loss FROM bl""")

    sign = ("sum(CASE WHEN substr(md5('{b}/' || c), {d}, 1) >= '8' THEN n ELSE -n END)")
    dims = ", ".join(sign.format(b=d // 32, d=d % 32 + 1) for d in range(40))
    q["token_vectors"] = with_events(f""",
pairs AS (SELECT a.token, b.token AS c, count(*) AS n
          FROM toks a JOIN toks b ON a.pos = b.pos AND a.token_pos <> b.token_pos
                                 AND abs(a.token_pos - b.token_pos) <= 2
          GROUP BY a.token, b.token)
SELECT token, array_to_string([{dims}], ',') AS vector FROM pairs GROUP BY token""")

    steps = """
cnt AS (SELECT model_id, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
        FROM scores WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY model_id, score),
alls AS (SELECT model_id, count(*) FILTER (WHERE label = 1) AS p FROM scores GROUP BY model_id),
cur AS (SELECT c.model_id, c.score AS threshold, c.pos, p,
               CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp
        FROM cnt c JOIN alls a ON a.model_id = c.model_id WINDOW w AS (PARTITION BY c.model_id ORDER BY c.score DESC)),
crv AS (SELECT *, p - tp AS fn, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CASE WHEN p = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / p END AS recall,
               CASE WHEN tp + fp + p = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (tp + fp + p) END AS f1 FROM cur)"""
    q["score_curve"] = "WITH " + _scores_sql().strip() + "," + steps + """
SELECT model_id, round(threshold, 6) AS threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM crv"""
    q["average_precision"] = "WITH " + _scores_sql().strip() + "," + steps + """
SELECT model_id, count(*) AS n_steps, round(sum(CASE WHEN p = 0 THEN 0.0 ELSE CAST(pos AS DOUBLE) / p END * precision), 6) AS average_precision,
       round(max(f1), 6) AS best_f1, round(max(threshold) FILTER (WHERE f1 = m), 6) AS best_threshold
FROM (SELECT *, max(f1) OVER (PARTITION BY model_id) AS m FROM crv) GROUP BY model_id"""

    q["vocabulary_growth"] = with_events(""",
half AS (SELECT max(event_id) // 2 AS h FROM events),
parts AS (SELECT t.token, count(*) FILTER (WHERE r.event_id <= h) AS f1, count(*) FILTER (WHERE r.event_id > h) AS f2
          FROM toks t JOIN rec r ON r.pos = t.pos CROSS JOIN half GROUP BY t.token),
v1 AS (SELECT token, row_number() OVER (ORDER BY f1 DESC, token) + 1 AS token_id, f1 + f2 AS freq FROM parts WHERE f1 > 0),
v2 AS (SELECT token, (SELECT max(token_id) FROM v1) + row_number() OVER (ORDER BY f2 DESC, token) AS token_id, f2 AS freq
       FROM parts WHERE f1 = 0)
SELECT token, CAST(token_id AS BIGINT) AS token_id, freq, CAST(1 AS INTEGER) AS version FROM v1
UNION ALL SELECT token, CAST(token_id AS BIGINT), freq, CAST(2 AS INTEGER) FROM v2""")

    q["token_pmi"] = with_events(""",
pairs AS (SELECT a.token, b.token AS context, count(*) AS n
          FROM toks a JOIN toks b ON a.pos = b.pos AND a.token_pos <> b.token_pos AND abs(a.token_pos - b.token_pos) <= 2
          GROUP BY a.token, b.token),
alone AS (SELECT token, sum(n) AS m FROM pairs GROUP BY token),
pmi AS (SELECT p.token, p.context, n, ln(n * CAST((SELECT sum(n) FROM pairs) AS DOUBLE) / (CAST(a.m AS DOUBLE) * CAST(c.m AS DOUBLE))) AS ppmi
        FROM pairs p JOIN alone a ON a.token = p.token JOIN alone c ON c.token = p.context)
SELECT token, context, n, round(ppmi, 6) AS ppmi FROM pmi WHERE ppmi > 0""")

    q["batches_stored"] = """
WITH p AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events)
SELECT CAST(pos // 1000 AS BIGINT) AS chunk_id, CAST((pos % 1000) // 128 AS BIGINT) AS batch_id, count(*) AS n,
       min(event_id) AS first_event, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS attacks
FROM p GROUP BY ALL"""
    q["align_stored"] = """
WITH p AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events)
SELECT event_id, CAST(pos // 1000 AS BIGINT) AS chunk_id, CAST(pos % 1000 AS BIGINT) AS row_in_chunk, least(value / 100.0, 1.0) AS score,
       CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS label
FROM p WHERE event_id % 2 = 0 AND value <= 90"""

    q["wide_records"] = _wide_sql()
    return q

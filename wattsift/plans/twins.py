"""DuckDB text of the fixture views, as WITH items to put in front of a twin query."""

RAW = """
events_k AS (
  SELECT event_id, user_id, event_type, ts, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events),
raw_runs AS (
  SELECT event_id AS run_id, event_id // 2 AS prompt_id, event_id // 18 AS item_id,
         CASE WHEN event_id % 2 = 0 THEN 'F16' ELSE 'Q4_K_M' END AS precision,
         user_id % 5 AS platform,
         CASE WHEN user_id % 2 = 0 THEN 'cache_on' ELSE 'cache_off' END AS regime,
         event_type AS category,
         CASE WHEN event_id % 3 = 0 THEN concat(' ', upper(event_type)) ELSE event_type END AS category_raw,
         user_id AS device, ts AS started_at,
         CASE WHEN k = 0 THEN 0e0 ELSE value / 5e0 END AS latency_s,
         value * k / 10e0 AS gross_energy_j,
         2.1e0 + (user_id % 5) * 3e0 AS idle_w,
         CASE WHEN event_id % 11 <> 0 THEN CAST(1 + (event_id * 7 + k) % 10 AS DOUBLE) END AS q_ped,
         k * 3 AS generated_tokens, least(k * 3, 200) AS output_tokens,
         CASE WHEN k % 10 <> 0 THEN 1800e0 + k * 8 END AS cpu_freq_mhz
  FROM events_k)"""

RUNS = RAW + """,
net_runs AS (SELECT *, greatest(gross_energy_j - idle_w * latency_s, 0.01e0) AS net_energy_j FROM raw_runs),
runs AS (
  SELECT *, CASE WHEN latency_s > 0 THEN net_energy_j / latency_s ELSE 0e0 END AS power_net_w,
         CASE WHEN latency_s > 0 THEN gross_energy_j / latency_s ELSE 0e0 END AS power_gross_w,
         CASE WHEN latency_s > 0 THEN CAST(output_tokens AS DOUBLE) / latency_s ELSE 0e0 END AS tokens_per_s,
         CASE WHEN q_ped IS NULL THEN NULL
              WHEN net_energy_j * latency_s > 0 THEN q_ped / (net_energy_j * latency_s) ELSE 0e0 END AS lpw,
         coalesce(cpu_freq_mhz < 2100, false) AS throttled
  FROM net_runs)"""

SCORES = """
votes AS (
  SELECT l_partkey // 4 AS item_id, CASE WHEN l_orderkey % 2 = 0 THEN 'F16' ELSE 'Q4_K_M' END AS precision,
         (l_suppkey + l_partkey) % 13 AS rater_id,
         CASE WHEN (l_suppkey + l_partkey) % 13 < 10 THEN 'human' ELSE 'ai' END AS rater_kind,
         CASE l_linenumber % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'CC' WHEN 2 THEN 'SQ' ELSE 'LA' END AS dim,
         1 + CAST(floor(l_quantity) AS BIGINT) % 10 AS score,
         l_shipdate, l_orderkey, l_extendedprice, l_linenumber, l_quantity
  FROM lineitem),
scores AS (
  SELECT item_id, precision, rater_id, rater_kind, dim, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id, precision, rater_id, dim ORDER BY l_shipdate DESC,
              l_orderkey DESC, l_extendedprice DESC, l_linenumber DESC, l_quantity DESC) AS rn FROM votes)
  WHERE rn = 1)"""

PANEL = SCORES + """,
panel AS (
  SELECT item_id, precision, dim,
         avg(score) FILTER (rater_kind = 'human') AS human_mean, avg(score) FILTER (rater_kind = 'ai') AS ai_mean,
         count(*) FILTER (rater_kind = 'human') AS n_human, count(*) FILTER (rater_kind = 'ai') AS n_ai
  FROM scores GROUP BY ALL),
quality AS (
  SELECT item_id, precision, avg(0.6e0 * human_mean + 0.4e0 * ai_mean) AS q_ped
  FROM panel GROUP BY ALL HAVING count(0.6e0 * human_mean + 0.4e0 * ai_mean) = 4)"""

TURNS = """
turns AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

POWER = """
power AS (
  SELECT user_id AS device, event_id AS sample_id, ts, value AS watts,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id
              ROWS UNBOUNDED PRECEDING) AS BIGINT) / 1e8 AS counter_kwh
  FROM events),
steps AS (
  SELECT *, lag(counter_kwh) OVER w AS prev_kwh, lag(ts) OVER w AS prev_ts, lag(watts) OVER w AS prev_w
  FROM power WINDOW w AS (PARTITION BY device ORDER BY ts, sample_id))"""

EXECUTIONS = """
executions AS (
  SELECT event_id AS run_id, user_id AS device, ts AS t0, ts + INTERVAL 12 HOUR AS t1
  FROM events)"""

REPLIES = """
replies AS (
  SELECT event_id AS run_id,
    CASE event_id % 6
      WHEN 0 THEN concat('{"score": ', CAST(1 + k % 10 AS VARCHAR), ', "reason": "ok"}')
      WHEN 1 THEN concat('{"score": ', CAST(1 + k % 10 AS VARCHAR), '}')
      WHEN 2 THEN 'Sure! {"score": 8}'
      WHEN 3 THEN '{"reason": "no score"}'
      WHEN 4 THEN concat('{"score": ', CAST(k AS VARCHAR), ', "reason": "range"} ')
      ELSE concat('{"CA": ', CAST(1 + k % 10 AS VARCHAR), ', "CC": 7, "SQ": 6, "LA": 8}') END AS reply
  FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)),
objects AS (
  SELECT run_id, reply, CASE WHEN json_valid(trim(reply)) AND trim(reply) LIKE '{%' THEN trim(reply) END AS doc
  FROM replies),
judged AS (
  SELECT run_id, reply, coalesce(TRY_CAST(json_extract_string(doc, '$.score') AS BIGINT), 7) AS score,
         CASE WHEN TRY_CAST(json_extract_string(doc, '$.score') AS BIGINT) IS NULL THEN 'scoring_failed'
              ELSE coalesce(json_extract_string(doc, '$.reason'), '') END AS reason,
         TRY_CAST(json_extract_string(doc, '$.score') AS BIGINT) IS NOT NULL AS parse_ok
  FROM objects)"""

PLATFORMS = """
platforms AS (
  SELECT CAST(r_regionkey AS BIGINT) AS platform, r_name AS platform_name, 25.6e0 * (r_regionkey + 1) AS mem_bw_gbs,
         4e0 * (r_regionkey + 1) AS ram_gb
  FROM region)"""

MODELS = """
models AS (
  SELECT p_partkey AS model_id,
         concat(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN 'F16' ELSE 'Q4_K_M' END) AS model_label,
         p_size / 2e0 AS ram_needed_gb
  FROM part)"""

PROMPTS = """
prompts AS (
  SELECT doc_id AS prompt_id, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS corpus, lang AS category,
         text AS prompt
  FROM documents)"""


def twin(*views: str, body: str) -> str:
    """Views and a query; a body that opens with a comma adds WITH items of its own."""
    body = body.strip()
    return "WITH " + ",".join(views) + ("" if body.startswith(",") else "\n") + body


def seconds(start: str, end: str) -> str:
    return f"date_diff('microsecond', {start}, {end}) / 1e6"


def words(column: str) -> str:
    return rf"list_filter(string_split_regex({column}, '\s+'), lambda x: x <> '')"


def decimal_round(column: str, digits: int) -> str:
    """Half-up rounding of the shortest decimal form; plain ``round`` scales in binary and moves ties."""
    return f"CAST(round(CAST(CAST({column} AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"

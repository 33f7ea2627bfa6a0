"""The same results as plain SQL over the given tables, written independently of the Spark plans.

Recursions are recursive queries over the row number, frames span whole series, and nothing is cut
into blocks.
"""

from __future__ import annotations

# Written out here, so that a wrong value in the library shows.
START, END = "2024-01-05", "2024-01-25"
POSITIVE, NEGATIVE = ["with", "for", "that", "was", "der", "la"], ["is", "it", "on", "as", "die", "le"]
PRICE_COLUMNS = [
    "open", "high", "low", "close", "volume", "vwap", "rsi", "macd", "macd_signal",
    "bollinger_h", "bollinger_l", "atr", "return", "future_volatility",
]
SENTIMENT_COLUMNS = ["sentiment_score", "tweet_count", "likes", "retweets", "weighted_sentiment"]
FEATURES = [
    "open", "high", "low", "close", "volume", "rsi", "macd", "macd_signal", "bollinger_h",
    "bollinger_l", "return", "sentiment_score", "tweet_count", "likes", "retweets",
    "weighted_sentiment", "atr", "vwap",
]
COUNT_FEATURES = ["volume", "tweet_count", "likes", "retweets"]
TARGET = "future_volatility"
LIMITS = {
    "close_factor": (0.8, 1.2), "ret": (-0.1, 0.1), "sentiment": (-1.0, 1.0),
    "tweets": (0.0, 10000.0), "likes": (0.0, 50000.0), "retweets": (0.0, 25000.0),
}
PRESETS = {
    "last_hour": (1.0, None, None, None, None, None),
    "bull": (1.08, 0.065, 0.82, 5200, 16000, 4500),
    "crash": (0.91, -0.09, -0.78, 7800, 22000, 8500),
    "quiet": (1.0, 0.0, 0.05, 280, 650, 180),
}

# Each name may use the names before it.
_PARTS: dict[str, str] = {}


def _q(c: str) -> str:
    return f'"{c}"'


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::double AS {_q(name)}"


def _rounded(cols, prefix: str = "") -> str:
    return ", ".join(_r(prefix + _q(c), c) for c in cols)


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_PARTS["bars_raw"] = """
SELECT symbol, ts, event_id AS bar_id, value AS open,
       value + (event_id % 7)::double / 10.0::double + 0.2::double AS high,
       greatest(value - (event_id % 5)::double / 10.0::double, 0::double) AS low,
       CASE WHEN event_id % 53 <> 0 THEN value + (event_id % 3)::double / 10.0::double END AS close,
       regexp_extract(props, '[0-9]+')::double AS volume
FROM (SELECT event_type AS symbol, ts, event_id, value + pow(2::double, length(event_type)) * 125::double AS value, props FROM events)"""

_PARTS["bars"] = """
SELECT symbol, hour, open, high, low, close, volume,
       coalesce(tpv / nullif(volume, 0), close) AS vwap
FROM (
  SELECT symbol, date_trunc('hour', ts)::timestamp AS hour,
         first(open ORDER BY ts, bar_id) FILTER (WHERE open IS NOT NULL) AS open,
         max(high) AS high, min(low) AS low,
         last(close ORDER BY ts, bar_id) FILTER (WHERE close IS NOT NULL) AS close,
         coalesce(sum(volume), 0) AS volume,
         coalesce(sum((high + low + close) / 3.0::double * volume), 0) AS tpv
  FROM bars_raw GROUP BY ALL)"""

_PARTS["filled"] = """
SELECT g.symbol, g.hour,
       last_value(b.open IGNORE NULLS) OVER w AS open, last_value(b.high IGNORE NULLS) OVER w AS high,
       last_value(b.low IGNORE NULLS) OVER w AS low, last_value(b.close IGNORE NULLS) OVER w AS close,
       CASE WHEN b.symbol IS NULL THEN 0::double ELSE b.volume END AS volume,
       last_value(b.vwap IGNORE NULLS) OVER w AS vwap
FROM (SELECT symbol, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM bars GROUP BY symbol) g
LEFT JOIN bars b ON b.symbol = g.symbol AND b.hour = g.hour
WINDOW w AS (PARTITION BY g.symbol ORDER BY g.hour ROWS UNBOUNDED PRECEDING)"""

_PARTS["moves"] = """
SELECT *, row_number() OVER w AS rn,
       count(close) OVER (w ROWS UNBOUNDED PRECEDING) AS seen,
       lag(close) OVER w AS prev
FROM filled WINDOW w AS (PARTITION BY symbol ORDER BY hour)"""

_PARTS["steps"] = """
SELECT *, coalesce(greatest(close - prev, 0), 0) AS gain, coalesce(greatest(prev - close, 0), 0) AS loss,
       greatest(high - low, abs(high - prev), abs(low - prev)) AS tr,
       close / nullif(prev, 0) - 1 AS ret
FROM moves"""

_PARTS["scan"] = """
SELECT symbol, rn, gain AS up, loss AS dn, close AS fast, close AS slow,
       NULL::double AS signal, tr AS trsum, NULL::double AS atr
FROM steps WHERE rn = 1
UNION ALL
SELECT n.symbol, n.rn, n.up, n.dn, n.fast, n.slow,
       CASE WHEN n.seen < 26 THEN NULL WHEN n.seen = 26 THEN n.fast - n.slow
            ELSE 0.2::double * (n.fast - n.slow) + 0.8::double * n.signal END,
       n.trsum,
       CASE WHEN n.rn < 14 THEN NULL WHEN n.rn = 14 THEN n.trsum / 14 ELSE (n.atr * 13 + n.tr) / 14 END
FROM (
  SELECT b.symbol, b.rn, b.seen, b.tr, s.signal, s.atr, s.trsum + b.tr AS trsum,
         (13 * s.up + b.gain) / 14 AS up, (13 * s.dn + b.loss) / 14 AS dn,
         coalesce((11 * s.fast + 2 * b.close) / 13, b.close) AS fast,
         coalesce((25 * s.slow + 2 * b.close) / 27, b.close) AS slow
  FROM scan s JOIN steps b ON b.symbol = s.symbol AND b.rn = s.rn + 1) n"""

_PARTS["indicators"] = """
SELECT t.symbol, t.hour, t.open, t.high, t.low, t.close, t.volume, t.vwap,
       CASE WHEN t.rn >= 14 THEN coalesce(100 - 100 / (1 + s.up / nullif(s.dn, 0)), 100) END AS rsi,
       CASE WHEN t.seen >= 26 THEN s.fast - s.slow END AS macd,
       CASE WHEN t.seen >= 34 THEN s.signal END AS macd_signal,
       CASE WHEN count(t.close) OVER m = 20 THEN avg(t.close) OVER m + 2 * stddev_pop(t.close) OVER m END AS bollinger_h,
       CASE WHEN count(t.close) OVER m = 20 THEN avg(t.close) OVER m - 2 * stddev_pop(t.close) OVER m END AS bollinger_l,
       s.atr, t.ret AS "return",
       CASE WHEN count(t.ret) OVER f = 24 THEN stddev_samp(t.ret) OVER f END AS future_volatility
FROM steps t JOIN scan s ON s.symbol = t.symbol AND s.rn = t.rn
WINDOW m AS (PARTITION BY t.symbol ORDER BY t.hour ROWS 19 PRECEDING),
       f AS (PARTITION BY t.symbol ORDER BY t.hour ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)"""

_PARTS["features"] = "SELECT * FROM indicators WHERE " + " AND ".join(f"{_q(c)} IS NOT NULL" for c in PRICE_COLUMNS)

_PARTS["posts_raw"] = """
SELECT post_id,
       CASE WHEN doc_id % 101 = 100 THEN 'bad'
            ELSE strftime(TIMESTAMP '2023-12-31 06:00:00' + to_days((doc_id % 32)::int)
                          + to_minutes((doc_id * 7919) % 960), '%Y-%m-%d %H:%M:%S') END AS "timestamp",
       text, (doc_id % 3)::varchar AS replies,
       CASE WHEN doc_id % 11 = 0 THEN 'n/a' WHEN doc_id % 7 = 0 THEN '3.7' ELSE (n_chars % 97)::varchar END AS likes,
       (doc_id % 13)::varchar AS retweets
FROM (SELECT doc_id, doc_id AS post_id, n_chars, CASE WHEN doc_id % 5 = 0
               THEN 'RT @user_' || doc_id || ' Tom &amp; Al ' || text || ' https://t.co/x' || doc_id || ' #topic' ELSE text END AS text
      FROM documents
      UNION ALL
      SELECT doc_id, -1 - doc_id, n_chars, CASE WHEN doc_id % 97 = 0 THEN 'RT' END FROM documents
      WHERE doc_id % 97 = 0 OR doc_id % 89 = 1)"""

_PARTS["posts"] = r"""
SELECT * FROM (
  SELECT post_id, try_cast("timestamp" AS timestamp) AS "timestamp",
         trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(
           replace(coalesce(text, ''), '&amp;', '&'), 'http\S+', '', 'g'), '@[\pL\pN_]+', '', 'g'), '\bRT\b', '', 'g'), '#', ''),
           '\s+', ' ', 'g')) AS text,
         coalesce(trunc(try_cast(replies AS double)), 0)::bigint AS replies,
         coalesce(trunc(try_cast(likes AS double)), 0)::bigint AS likes,
         coalesce(trunc(try_cast(retweets AS double)), 0)::bigint AS retweets
  FROM posts_raw) WHERE length(text) >= 3"""

_PARTS["tokens"] = f"""
SELECT *, len(list_filter(words, lambda w: w IN ({_list(POSITIVE)}))) AS pos,
          len(list_filter(words, lambda w: w IN ({_list(NEGATIVE)}))) AS neg
FROM (SELECT *, regexp_split_to_array(lower(text), '[^a-zà-ÿ]+') AS words FROM posts)"""

_PARTS["scored"] = """
SELECT *, CASE WHEN pos > neg THEN 'positive' WHEN pos < neg THEN 'negative' ELSE 'neutral' END AS label,
       coalesce((pos - neg)::double / nullif(pos + neg, 0), 0) AS sentiment_score
FROM tokens"""

_PARTS["sentiment"] = """
SELECT *, sentiment_score * ln(likes + retweets + 2) AS weighted_sentiment FROM (
  SELECT date_trunc('hour', "timestamp")::timestamp AS hour, avg(sentiment_score) AS sentiment_score,
         count(text) AS tweet_count, avg(likes) AS likes, avg(retweets) AS retweets
  FROM scored WHERE "timestamp" IS NOT NULL GROUP BY ALL)"""

_PARTS["fused"] = f"""
SELECT p.symbol, p.hour, {", ".join("p." + _q(c) for c in PRICE_COLUMNS)},
       coalesce(last_value(s.sentiment_score IGNORE NULLS) OVER w, 0) AS sentiment_score,
       coalesce(s.tweet_count, 0)::double AS tweet_count, coalesce(s.likes, 0) AS likes,
       coalesce(s.retweets, 0) AS retweets,
       coalesce(last_value(s.weighted_sentiment IGNORE NULLS) OVER w, 0) AS weighted_sentiment
FROM features p LEFT JOIN sentiment s ON s.hour = p.hour
WINDOW w AS (PARTITION BY p.symbol ORDER BY p.hour ROWS UNBOUNDED PRECEDING)"""

_PARTS["matrix"] = f"""
SELECT symbol, hour, {", ".join(f"ln(1 + {c}) AS {c}" if c in COUNT_FEATURES else _q(c) for c in FEATURES)}, {TARGET}
FROM fused"""

_PARTS["split"] = """
SELECT *, CASE WHEN rn <= floor(n * 0.8::double) THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hour) AS rn,
             count(*) OVER (PARTITION BY symbol) AS n FROM matrix)"""


def _scaled(c: str) -> str:
    low, high = (f"(SELECT {f}({_q(c)}) FROM split WHERE split = 'train')" for f in ("min", "max"))
    return f"({_q(c)} - {low}) / coalesce(nullif({high} - {low}, 0), 1)"


_PARTS["scaled"] = f"""
SELECT symbol, hour, {", ".join(f"{_scaled(c)} AS {_q(c)}" for c in [*FEATURES, TARGET])}, split FROM split"""

_PARTS["forecasts"] = """
SELECT * FROM (
  SELECT symbol, hour, future_volatility AS actual, lag(future_volatility) OVER w AS previous,
         CASE WHEN count(*) OVER d = 24 THEN avg(future_volatility) OVER d END AS mean24
  FROM features
  WINDOW w AS (PARTITION BY symbol ORDER BY hour),
         d AS (PARTITION BY symbol ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
WHERE mean24 IS NOT NULL"""


def _metrics(y: str, pred: str) -> str:
    return (
        f'avg(abs({pred} - {y})) AS "MAE", sqrt(avg(({pred} - {y}) ** 2)) AS "RMSE", '
        f'1 - sum(({pred} - {y}) ** 2) / (count(*) * var_pop({y})) AS "R2"'
    )


_PARTS["metrics"] = f"""
SELECT 'Previous' AS model, {_metrics("actual", "previous")} FROM forecasts
UNION ALL SELECT 'Mean24', {_metrics("actual", "mean24")} FROM forecasts"""

_PARTS["curve"] = """
SELECT w, sqrt(avg((w * previous + (1 - w) * mean24 - actual) ** 2)) AS rmse
FROM forecasts, (SELECT i::double / 100 AS w FROM range(101) t(i)) GROUP BY w"""

_PARTS["ensemble"] = f"""
SELECT 'Ensemble_Blend (w=' || printf('%.2f', any_value(w)) || ')' AS model, {_metrics("actual", "p")}
FROM (SELECT w, actual, w * previous + (1 - w) * mean24 AS p
      FROM forecasts, (SELECT w FROM curve ORDER BY rmse, w LIMIT 1))"""

_PARTS["board"] = """
SELECT 0 AS source, * FROM metrics UNION ALL SELECT 2, * FROM ensemble"""

_DAILY = [*PRICE_COLUMNS, *SENTIMENT_COLUMNS]


def _daily(table: str, cols) -> str:
    means = ", ".join(f"avg({_q(c)}) AS {_q(c)}" for c in cols)
    return f"""
SELECT g.symbol, g.day, {", ".join("v." + _q(c) for c in cols)}
FROM (SELECT symbol, unnest(generate_series(min(date_trunc('day', hour)::timestamp), max(date_trunc('day', hour)::timestamp),
      INTERVAL 1 DAY)) AS day FROM {table} GROUP BY symbol) g
LEFT JOIN (SELECT symbol, date_trunc('day', hour)::timestamp AS day, {means} FROM {table} GROUP BY ALL) v
  ON v.symbol = g.symbol AND v.day = g.day"""


_PARTS["daily"] = _daily("fused", _DAILY)
_PARTS["matrix_daily"] = _daily("matrix", [TARGET])


def _bounds(table: str, time: str, level: str) -> str:
    return f"""
SELECT symbol, count(*) FILTER (WHERE rn <= cut) AS n_train, count(*) FILTER (WHERE rn > cut) AS n_test,
       max({time}) FILTER (WHERE rn <= cut) AS train_end, min({time}) FILTER (WHERE rn > cut) AS test_start,
       max({time}) FILTER (WHERE rn > cut) AS test_end, '{level}' AS level
FROM (SELECT symbol, {time}, row_number() OVER (PARTITION BY symbol ORDER BY {time}) AS rn,
             floor(count(*) OVER (PARTITION BY symbol) * 0.8::double) AS cut FROM {table}) GROUP BY symbol"""


def _preset_rows() -> str:
    def value(v):
        return "NULL::double" if v is None else f"{float(v)!r}::double"

    rows = [f"('{name}', " + ", ".join(map(value, values)) + ")" for name, values in PRESETS.items()]
    return f"(VALUES {', '.join(rows)}) AS p(preset, {', '.join('p_' + f for f in LIMITS)})"


def _held(expr: str, name: str) -> str:
    low, high = LIMITS[name]
    return f"least(greatest({expr}, {low!r}::double), {high!r}::double)"


def _scenario_values() -> dict[str, str]:
    whole = {"tweets", "likes", "retweets"}
    given = {"return": "ret", "sentiment_score": "sentiment", "tweet_count": "tweets", "likes": "likes", "retweets": "retweets"}
    value = {c: _q(c) for c in FEATURES}
    for c in ("open", "high", "low", "close"):
        value[c] = f"CASE WHEN is_last THEN {c} * {_held('p_close_factor', 'close_factor')} ELSE {c} END"
    new = {}
    for c, name in given.items():
        now = f"trunc({_q(c)})" if name in whole else _q(c)
        new[c] = f"CASE WHEN p_{name} IS NULL THEN {_held(now, name)} ELSE {_held('p_' + name, name)} END"
        value[c] = f"CASE WHEN is_last THEN {new[c]} ELSE {_q(c)} END"
    weight = f"({new['sentiment_score']}) * ln(({new['likes']}) + ({new['retweets']}) + 2)"
    value["weighted_sentiment"] = f"CASE WHEN is_last THEN {weight} ELSE weighted_sentiment END"
    return value


def _scenario_columns() -> str:
    return ", ".join(_r(value, c) for c, value in _scenario_values().items())


_PARTS["ranged"] = "SELECT * FROM fused WHERE hour >= TIMESTAMP '2024-01-10 05:00:00'"
_PARTS["ranged_daily"] = _daily("ranged", _DAILY)

_PARTS["quiet"] = """
SELECT symbol, hour, seen, row_number() OVER w AS rn, close, coalesce(greatest(close - lag(close) OVER w, 0), 0) AS gain,
       coalesce(greatest(lag(close) OVER w - close, 0), 0) AS loss
FROM (SELECT symbol, hour, close, count(close) OVER (PARTITION BY symbol ORDER BY hour ROWS UNBOUNDED PRECEDING) AS seen
      FROM (SELECT symbol, hour, CASE WHEN symbol = 'view' AND hour >= TIMESTAMP '2024-01-04 00:00:00' THEN 2050::double ELSE close END AS close
            FROM filled))
WINDOW w AS (PARTITION BY symbol ORDER BY hour)"""

_PARTS["quiet_scan"] = """
SELECT symbol, rn, gain AS up, loss AS dn FROM quiet WHERE rn = 1
UNION ALL
SELECT b.symbol, b.rn, (13 * s.up + b.gain) / 14, (13 * s.dn + b.loss) / 14
FROM quiet_scan s JOIN quiet b ON b.symbol = s.symbol AND b.rn = s.rn + 1"""


def _spans(name: str, fast: int, slow: int, signal: int) -> None:
    """Exponential means of the quiet bars and of their difference, by recursion."""

    def step(kept: str, new: str, span: int) -> str:
        return f"coalesce(({span - 1} * {kept} + 2 * {new}) / {span + 1}, {new}, {kept})"

    _PARTS[f"{name}_scan"] = f"""
SELECT symbol, rn, seen, close AS fast, close AS slow, CASE WHEN seen >= {slow} THEN 0::double END AS signal FROM quiet WHERE rn = 1
UNION ALL
SELECT symbol, rn, seen, fast, slow,
       CASE WHEN seen >= {slow} THEN {step("signal", "(fast - slow)", signal)} END
FROM (SELECT b.symbol, b.rn, b.seen, {step("s.fast", "b.close", fast)} AS fast, {step("s.slow", "b.close", slow)} AS slow, s.signal
      FROM {name}_scan s JOIN quiet b ON b.symbol = s.symbol AND b.rn = s.rn + 1)"""


_spans("fast", 2, 26, 9)
_spans("slow", 12, 200, 3)

_PARTS["recent"] = """
SELECT *, back = 1 AS is_last
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hour DESC) AS back FROM fused) WHERE back <= 12"""

# Least squares of the scaled target by normal equations, solved by Gauss-Jordan elimination: a step for each feature.
_PARTS["moments"] = "SELECT [" + ", ".join(
    "[" + ", ".join(f"covar_pop({_q(a)}, {_q(b)})" for b in [*FEATURES, TARGET]) + "]" for a in FEATURES
) + f"] AS m, [{', '.join(f'avg({_q(c)})' for c in [*FEATURES, TARGET])}] AS means FROM scaled WHERE split = 'train'"
_PARTS["elimination"] = f"""
SELECT 1 AS k, m, means FROM moments UNION ALL
SELECT k + 1, list_transform(m, lambda r, i: CASE
         WHEN m[k][k] < 1e-13 THEN r
         WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
         ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END), means
FROM elimination WHERE k <= {len(FEATURES)}"""
_PARTS["line"] = f"""
SELECT w, means[{len(FEATURES) + 1}] - list_dot_product(w, means[1:{len(FEATURES)}]) AS b
FROM (SELECT means, list_transform(m, lambda r, i: CASE WHEN r[i] < 1e-13 THEN 0 ELSE r[{len(FEATURES) + 1}] END) AS w
      FROM elimination WHERE k = {len(FEATURES) + 1})"""
_PARTS["target_range"] = f"SELECT min({TARGET}) AS target_low, max({TARGET}) - min({TARGET}) AS target_width FROM split WHERE split = 'train'"
_LINE = f"target_low + target_width * (b + list_dot_product(w, [{', '.join(map(_q, FEATURES))}]))"
_PARTS["scenario_last"] = f"""
SELECT symbol, preset, {", ".join(f"ln(1 + {v}) AS {_q(c)}" if c in COUNT_FEATURES else f"{v} AS {_q(c)}" for c, v in _scenario_values().items())}
FROM recent, {_preset_rows()} WHERE is_last"""
_PARTS["scenario_scaled"] = f"SELECT symbol, preset, {', '.join(f'{_scaled(c)} AS {_q(c)}' for c in FEATURES)} FROM scenario_last"
_PARTS["scenario_line"] = f"SELECT symbol, preset, {_LINE} AS v FROM scenario_scaled JOIN line ON true JOIN target_range ON true"

_BAR = ["open", "high", "low", "close", "volume", "vwap"]
_METRIC = ["MAE", "RMSE", "R2"]
_SENT = f"hour, {_r('sentiment_score', 'sentiment_score')}, tweet_count, {_rounded(['likes', 'retweets', 'weighted_sentiment'])}"
_POST_AT = '"timestamp"'
_CLOSE = "close"


def _seq(i: int, c: str) -> str:
    return f"lag({c}, {i}) OVER w"


_FINAL: dict[str, str] = {
    "hourly_bars": f"SELECT symbol, hour, {_rounded(_BAR)} FROM bars",
    "bars_filled": f"SELECT symbol, hour, {_rounded(_BAR)} FROM filled",
    "resample_mean": "SELECT symbol, date_trunc('hour', ts)::timestamp AS hour, "
    + ", ".join(_r(f"avg({c})", c, 8) for c in ["bar_id", "open", "high", "low", "close", "volume"])
    + " FROM bars_raw GROUP BY symbol, date_trunc('hour', ts)",
    "returns_fwdvol": f"SELECT symbol, hour, {_rounded(['return', TARGET])} FROM indicators",
    "rsi": f"SELECT symbol, hour, {_rounded(['rsi'])} FROM indicators",
    "macd": f"SELECT symbol, hour, {_rounded(['macd', 'macd_signal'])} FROM indicators",
    "bollinger": f"SELECT symbol, hour, {_rounded(['bollinger_h', 'bollinger_l'])} FROM indicators",
    "atr": f"SELECT symbol, hour, {_rounded(['atr'])} FROM indicators",
    "price_features": f"SELECT symbol, hour, {_rounded(PRICE_COLUMNS)} FROM features",
    "lenient_casts": f"""
SELECT post_id, try_cast({_POST_AT} AS timestamp) AS ts,
       CASE WHEN post_id % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(post_id * 3601)
            ELSE try_cast({_POST_AT} AS timestamp) END AS ts_epoch_or_text,
       try_cast({_POST_AT} AS timestamp) - INTERVAL 2 HOUR AS ts_aware,
       try_cast({_POST_AT} AS timestamp) - INTERVAL 9 HOUR AS ts_from_zone,
       coalesce(trunc(try_cast(likes AS double)), 0)::bigint AS likes,
       coalesce(trunc(try_cast(retweets AS double)), 0)::bigint AS retweets FROM posts_raw""",
    "posts_clean": "SELECT * FROM posts",
    "posts_sample": f"SELECT post_id, {_POST_AT}, likes, retweets FROM posts ORDER BY {_POST_AT} NULLS LAST, post_id LIMIT 500",
    "posts_scored": f"""
SELECT post_id, label, {_r("abs(sentiment_score)", "probability")}, {_r("sentiment_score", "sentiment_score")} FROM scored""",
    "hourly_sentiment": f"SELECT {_SENT} FROM sentiment",
    "post_weighted": f"""
SELECT date_trunc('hour', {_POST_AT})::timestamp AS hour,
       {_r("avg(sentiment_score * ln(likes + retweets + 2))", "weighted_sentiment")}
FROM scored WHERE {_POST_AT} IS NOT NULL GROUP BY 1""",
    "sentiment_in_range": f"""
SELECT {_SENT} FROM sentiment
WHERE hour BETWEEN (SELECT min(hour) FROM features) AND (SELECT max(hour) FROM features)""",
    "fused_dataset": f"SELECT symbol, hour, {_rounded([*PRICE_COLUMNS, *SENTIMENT_COLUMNS])} FROM fused",
    "fusion_match": "SELECT count(*) AS n_rows, count(*) FILTER (WHERE tweet_count > 0) AS n_matched FROM fused",
    "model_matrix": f"""
SELECT symbol, hour, {_rounded([*FEATURES, TARGET])} FROM matrix
WHERE hour BETWEEN TIMESTAMP '{START} 00:00:00' AND TIMESTAMP '{END} 00:00:00'""",
    "split_bounds": _bounds("matrix", "hour", "hour") + " UNION ALL " + _bounds("matrix_daily", "day", "day"),
    "minmax_scaled": f"SELECT symbol, hour, {_rounded([*FEATURES, TARGET])}, split FROM scaled",
    "minmax_inverse": f"SELECT symbol, hour, {_rounded(['close', 'atr', TARGET])} FROM matrix",
    "sequence_windows": f"""
SELECT symbol, label_ts, {_r("label", "label")},
       CASE WHEN rn - 12 <= floor((n - 12) * 0.8::double) THEN 'train' ELSE 'test' END AS split,
       {12 * len(FEATURES)}::bigint AS n_cells, {_rounded(["first_close", "last_close", "last_vwap", "weighted_close"])}
FROM (SELECT symbol, hour AS label_ts, {TARGET} AS label, rn, n, {_seq(12, _CLOSE)} AS first_close,
             {_seq(1, _CLOSE)} AS last_close, {_seq(1, "vwap")} AS last_vwap,
             {" + ".join(f"{13 - i} * {_seq(i, _CLOSE)}" for i in range(12, 0, -1))} AS weighted_close
      FROM split WINDOW w AS (PARTITION BY symbol ORDER BY hour)) WHERE rn > 12""",
    "reg_metrics": f"SELECT model, {_rounded(_METRIC)} FROM metrics",
    "blend_search": f"SELECT {_rounded(['w', 'rmse'])} FROM curve",
    "leaderboard": f"""
SELECT source::bigint AS source, model, {", ".join(f"printf('%.6f', {_q(c)}) AS {_q(c)}" for c in _METRIC)},
       row_number() OVER (ORDER BY round("RMSE", 9), source, model) = 1 AS best FROM board""",
    "pred_bounds": f"""
SELECT {_r("least(min(actual), min(mean24))", "low")}, {_r("greatest(max(actual), max(mean24))", "high")} FROM forecasts""",
    "last_predictions": f"""
SELECT symbol, hour, {_rounded(["actual", "previous", "mean24"])} FROM forecasts
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY hour DESC) <= 150""",
    "daily_rollup": f"SELECT symbol, day, {_rounded(_DAILY)} FROM daily",
    "sentiment_ma7": f"""
SELECT symbol, day, {_rounded(["tweet_count", "sentiment_score"])},
       {_r("CASE WHEN count(sentiment_score) OVER w = 7 THEN avg(sentiment_score) OVER w END", "sentiment_ma")}
FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 6 PRECEDING)""",
    "kpi_summary": f"""
SELECT count(*) AS active_hours, {_r("sum(tweet_count)", "posts")}, {_r("avg(sentiment_score)", "mean_sentiment")},
       {_r(f"avg({TARGET}) * 100", "mean_volatility_pct")}
FROM fused WHERE hour BETWEEN TIMESTAMP '{START} 00:00:00' AND TIMESTAMP '{END} 00:00:00'""",
    "kpi_text": f"""
SELECT format('{{:,}}', count(*)) AS active_hours, format('{{:,}}', round(sum(tweet_count))::bigint) AS posts,
       printf('%.4f', avg(sentiment_score)) AS mean_sentiment,
       printf('%.3f', avg({TARGET}) * 100) || '%' AS mean_volatility_pct
FROM fused WHERE hour BETWEEN TIMESTAMP '{START} 00:00:00' AND TIMESTAMP '{END} 00:00:00'""",
    "vol_regimes": f"""
SELECT symbol, CASE WHEN {TARGET} < 0.005 THEN 'low' WHEN {TARGET} < 0.015 THEN 'normal' ELSE 'high' END AS regime,
       count(*) AS hours, {_r(f"avg({TARGET})", "mean")} FROM features GROUP BY ALL""",
    "data_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {str(c not in ('symbol', 'ts')).upper()} AS is_numeric, count(*) AS n_rows, "
        f"count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM bars_raw"
        for c in ["symbol", "ts", "bar_id", "open", "high", "low", "close", "volume"]
    ),
    "linreg_univariate": f"""
SELECT count(*) AS n, {_r(f"regr_slope({TARGET}, atr)", "slope")}, {_r(f"regr_intercept({TARGET}, atr)", "intercept")}
FROM matrix""",
    "scenario_features": f"SELECT symbol, preset, hour, is_last, {_scenario_columns()} FROM recent, {_preset_rows()}",
}


def _spread(name: str, slow: int, signal: int) -> str:
    return f"""
SELECT q.symbol, q.hour, {_r(f"CASE WHEN q.seen >= {slow} THEN s.fast - s.slow END", "macd")},
       {_r(f"CASE WHEN q.seen >= {slow + signal - 1} THEN s.signal END", "macd_signal")}
FROM quiet q JOIN {name}_scan s ON s.symbol = q.symbol AND s.rn = q.rn"""


_FINAL["quiet_rsi"] = f"""
SELECT q.symbol, q.hour, {_r("CASE WHEN q.rn >= 14 THEN coalesce(100 - 100 / (1 + s.up / nullif(s.dn, 0)), 100) END", "rsi")}
FROM quiet q JOIN quiet_scan s ON s.symbol = q.symbol AND s.rn = q.rn"""
_FINAL["macd_fast"], _FINAL["macd_slow"] = _spread("fast", 26, 9), _spread("slow", 200, 3)
_FINAL["bars_csv"] = f"""
SELECT symbol, hour, {_rounded(_BAR)} FROM (
  SELECT symbol, hour, open, high, low, close, volume, coalesce(tpv / nullif(volume, 0), close) AS vwap
  FROM (SELECT symbol, date_trunc('hour', ts)::timestamp AS hour,
               first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
               last(close ORDER BY ts) FILTER (WHERE close IS NOT NULL) AS close, coalesce(sum(volume), 0) AS volume,
               coalesce(sum((high + low + close) / 3.0::double * volume), 0) AS tpv FROM bars_raw GROUP BY ALL))"""
_FINAL["posts_csv"] = f"SELECT {_POST_AT}, text, likes, retweets, 0::bigint AS replies FROM posts"
_FINAL["minmax_reloaded"] = _FINAL["minmax_scaled"]
_FINAL["linreg_residuals"] = "SELECT unnest([" + _list(FEATURES) + "]) AS feature, 0::double AS product FROM (SELECT count(*) FROM matrix)"
_FINAL["stored_linear"] = f"""
SELECT symbol, hour, {_r(f"target_low + target_width * {TARGET}", "actual")}, {_r(_LINE, "LinearRegression")}
FROM scaled JOIN line ON true JOIN target_range ON true WHERE split = 'test'"""
_FINAL["scenario_scores"] = f"""
SELECT symbol, preset, {_r("v", "Linear")},
       CASE WHEN v < 0.005 THEN 'low' WHEN v < 0.015 THEN 'normal' ELSE 'high' END AS "Linear_regime" FROM scenario_line"""
_FINAL["linreg_by_symbol"] = f"""
SELECT symbol, count(*) AS n, {_r(f"regr_slope({TARGET}, atr)", "slope")}, {_r(f"regr_intercept({TARGET}, atr)", "intercept")}
FROM matrix GROUP BY symbol"""
_FINAL["bars_by_day"] = _FINAL["hourly_bars"]
_FINAL["daily_rollup_range"] = f"SELECT symbol, day, {_rounded(_DAILY)} FROM ranged_daily"
_FINAL["chart_price"] = f"SELECT symbol, day, {_rounded(['close', 'bollinger_h', 'bollinger_l'])} FROM daily"
_FINAL["chart_vol_sentiment"] = f"SELECT symbol, day, {_rounded([TARGET, 'sentiment_score'])} FROM daily"
_FINAL["series_close"] = f"SELECT symbol, hour, {_rounded(['close'])} FROM features"
_FINAL["stream_bars_closed"] = f"""
SELECT symbol, hour, {_rounded(_BAR)} FROM bars
WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM bars_raw) - INTERVAL 2 HOUR"""
_FINAL["sentiment_of_days"] = _FINAL["sentiment_in_range"]
_FINAL["stream_sentiment_closed"] = f"""
SELECT {_SENT} FROM sentiment
WHERE hour + INTERVAL 1 HOUR <= (SELECT max({_POST_AT}) FROM posts) - INTERVAL 2 HOUR"""
_FINAL["posts_scored_batches"] = _FINAL["posts_scored"]
_FINAL["stream_bars"] = _FINAL["hourly_bars"]
_FINAL["stream_sentiment"] = _FINAL["hourly_sentiment"]


def _needed(sql: str) -> list[str]:
    """Names of the parts a text uses, directly or not, in their order of definition."""
    import re

    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)|,\s*(?=\()", todo.pop()))
        for name in words & _PARTS.keys() - found:
            found.add(name)
            todo.append(_PARTS[name])
    return [name for name in _PARTS if name in found]


def registered() -> dict[str, str]:
    out = {}
    for name, sql in _FINAL.items():
        parts = ",\n".join(f"{p} AS ({_PARTS[p]})" for p in _needed(sql))
        out[name] = f"WITH RECURSIVE {parts}\n{sql}" if parts else sql
    return out

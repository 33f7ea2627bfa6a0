"""Table schemas and the column lists every stage agrees on."""

from __future__ import annotations

from pyspark.sql import types as T

_D = T.DoubleType()
_S = T.StringType()
_TS = T.TimestampNTZType()


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, _D) for n in names]


# The raw market feed as a CSV file has it: epoch seconds and five numbers.
BARS_CSV = T.StructType([T.StructField("Timestamp", _S), *_doubles("Open", "High", "Low", "Close", "Volume")])

# Posts arrive as text only; casts are lenient and happen later.
POST_COLUMNS = ["timestamp", "text", "replies", "likes", "retweets"]
POSTS_CSV = T.StructType([T.StructField(c, _S) for c in POST_COLUMNS])

RESULTS = T.StructType([T.StructField("model", _S), *_doubles("MAE", "RMSE", "R2")])
IMPORTANCES = T.StructType([T.StructField("feature", _S), *_doubles("importance")])

SCALER = T.StructType([T.StructField("column", _S), *_doubles("low", "high")])

PRICE_COLUMNS = [
    "open", "high", "low", "close", "volume", "vwap", "rsi", "macd", "macd_signal",
    "bollinger_h", "bollinger_l", "atr", "return", "future_volatility",
]
SENTIMENT_COLUMNS = ["sentiment_score", "tweet_count", "likes", "retweets", "weighted_sentiment"]

FUSED = T.StructType(
    [T.StructField("symbol", _S), T.StructField("hour", _TS), *_doubles(*PRICE_COLUMNS, *SENTIMENT_COLUMNS)]
)

# Model inputs in the order scalers, weights and scenarios index them.
FEATURES = [
    "open", "high", "low", "close", "volume", "rsi", "macd", "macd_signal", "bollinger_h",
    "bollinger_l", "return", "sentiment_score", "tweet_count", "likes", "retweets",
    "weighted_sentiment", "atr", "vwap",
]
TARGET = "future_volatility"
COUNT_FEATURES = ["volume", "tweet_count", "likes", "retweets"]
LOOKBACK = 12

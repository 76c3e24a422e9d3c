"""Universe files, constituents and raw price frames: read, clean, admit, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What is kept of a universe file.
UNIVERSE = "tickers array<struct<ticker:string,sector:string,pos:long,series:array<struct<date:date,open:double,high:double,low:double,close:double,volume:long>>>>"
#: Listings that count as the home exchange; an absent one does, too (fixed values).
HOME_EXCHANGES = ("", "NASDAQ", "NASDAQ GS", "NASDAQ GM", "NASDAQ CM", "NAS", "NASDAQGS", "NASDAQGM", "NASDAQCM")
#: Least number of clean bars of a series (fixed value).
MIN_TRADING_DAYS = 200
FIELDS = ("open", "high", "low", "close", "volume")


def read_universe(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """ticker, sector, pos, idx and the fields of a bar, of universe files: one JSON object with nested series each, or one a line.

    pos is the ticker's place in its object, unless the file states one, as files of many lines do.
    """
    tickers = spark.read.schema(UNIVERSE).option("multiLine", not lines).json(path).select(F.posexplode("tickers").alias("place", "t"))
    bars = tickers.select("t.ticker", "t.sector", F.coalesce("t.pos", "place").alias("pos"), F.posexplode("t.series").alias("idx", "b"))
    return bars.select("ticker", "sector", F.col("pos").cast("long").alias("pos"), F.col("idx").cast("long").alias("idx"), "b.*")


def write_universe(bars: DataFrame, path: str) -> None:
    """Bars (ticker, sector, pos, idx, date and fields) as lines of JSON objects of one ticker each, which read_universe reads with lines=True.

    The files appear when the whole job has committed; a failed job leaves the folder without its success mark. A series
    is one ticker's, a few thousand bars.
    """
    bar = F.struct("idx", F.struct("date", *FIELDS).alias("b"))
    series = bars.groupBy("ticker", "sector", "pos").agg(F.transform(F.array_sort(F.collect_list(bar)), lambda x: x["b"]).alias("series"))
    series.select(F.array(F.struct("ticker", "sector", "pos", "series")).alias("tickers")).write.mode("overwrite").json(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file, or none where it doesn't exist; records that don't parse are dropped."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


#: A note in brackets at the end of a ticker, as lists of holdings have them.
NOTE = r"\s*\([^)]*\)$"


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def normalised(ticker: Column) -> Column:
    """Upper case without outer blanks, a note in brackets at the end, and asterisks after it; dots of share classes stay."""
    bare = F.regexp_replace(F.upper(_stripped(ticker)), NOTE, "")
    return _stripped(F.rtrim(_stripped(bare), F.lit("*")))


def constituents(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ticker, name, sector) of the first line of each ticker, and (ticker, reason) of lines from other exchanges.

    lines: line (a number in order), ticker, name, sector, exchange, as read from CSV. Lines without a ticker, also once
    its notes are gone, are skipped; an empty name is the ticker, an empty sector Unknown.
    """
    lines = lines.filter(_stripped(F.coalesce("ticker", F.lit(""))) != "")
    home = F.upper(_stripped(F.coalesce("exchange", F.lit("")))).isin(*HOME_EXCHANGES)
    first = F.row_number().over(Window.partitionBy("t").orderBy("line"))
    known = lines.filter(home).withColumn("t", normalised(F.col("ticker"))).filter("t <> ''").withColumn("n", first).filter("n = 1")
    or_else = lambda c, other: _stripped(F.coalesce(F.when(F.col(c) != "", F.col(c)), other)).alias(c)
    included = known.select(F.col("t").alias("ticker"), or_else("name", F.col("t")), or_else("sector", F.lit("Unknown")))
    return included, lines.filter(~home).select(_stripped(F.col("ticker")).alias("ticker"), F.concat(F.lit("other exchange: "), "exchange").alias("reason"))


def cleaned(frame: DataFrame, least: int = MIN_TRADING_DAYS) -> tuple[DataFrame, DataFrame]:
    """Bars without gaps, rounded to four digits, and by ticker how many bars it has, how many were dropped, and why it is excluded (null: kept).

    A row with no field at all doesn't count as dropped; a ticker with fewer than `least` clean bars is excluded.
    """
    some = F.coalesce(*[F.col(c).cast("string") for c in FIELDS]).isNotNull()
    every = ~F.exists(F.array(*[F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in FIELDS]), lambda x: x)
    judged = frame.withColumns({"some": some, "every": every})
    log = judged.groupBy("ticker").agg(F.count_if("every").alias("bars"), F.count_if(F.col("some") & ~F.col("every")).alias("dropped"))
    log = log.withColumn("reason", F.when(F.col("bars") == 0, "no data").when(F.col("bars") < least, F.format_string(f"fewer than {least} bars: %d, and %d dropped", "bars", "dropped")))
    kept = judged.filter("every").join(log.filter("reason IS NULL").select("ticker"), "ticker", "left_semi")
    return kept.select("ticker", "date", *[F.round(F.col(c), 4).alias(c) for c in FIELDS[:-1]], F.col("volume").cast("long").alias("volume")), log


def admitted(requested: DataFrame, sufficiency: DataFrame) -> DataFrame:
    """ticker, accepted, reason of requested tickers against ticker, sufficient, reason of the universe."""
    known = sufficiency.select("ticker", "sufficient", F.col("reason").alias("lacks"))
    j = requested.select(F.upper("ticker").alias("ticker")).join(known, "ticker", "left")
    reason = F.when(F.col("sufficient").isNull(), "not in the universe").when(~F.col("sufficient"), F.coalesce("lacks", F.lit("too few bars")))
    return j.select("ticker", reason.isNull().alias("accepted"), reason.alias("reason"))

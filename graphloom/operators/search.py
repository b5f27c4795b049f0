"""Case-insensitive search for parts of a text by postings of its trigrams.

The index is a table of (trigram, text) dealt by the trigram's hash into folders, and beside it how
many texts have each trigram; a text is named by the digest of its lower-cased form, so rows of
one text are one.  A pattern is looked up by its rarest
trigrams only: texts that have them are candidates, which the text itself confirms, so what
is found is exactly what a scan finds.  A frequent trigram costs nothing unless a
pattern has no rarer one.  Distinct patterns meet distinct texts, and only the pairs found are
spread to rows, in a last join whose result is not shuffled again.

Defined results: a null text contains nothing; a null pattern finds nothing; an empty pattern finds
every text; patterns of one or two characters, which have no trigram, meet all parts of that
length of the texts in a join by the part; repeated patterns are answered each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = 64
RAREST = 3  # trigrams of a pattern that are looked up
PARTS = 32  # tasks at most that the rows of one text are dealt over


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the lower-cased text."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.length(low) - 2)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(3)))))


def short_grams(text: Column) -> Column:
    """The distinct parts of up to two characters of the lower-cased text, the empty one included."""
    low = F.lower(text)
    places = F.when(F.length(low) > 0, F.sequence(F.lit(1), F.length(low))).otherwise(F.array().cast("array<int>"))
    cut = lambda n: F.transform(places, lambda i: F.substring(low, i, F.lit(n)))
    return F.array_distinct(F.concat(F.array(F.lit("")), cut(1), cut(2)))


def text_id(text: Column) -> Column:
    """Rows whose texts differ in case only have the same."""
    return F.unhex(F.md5(F.lower(text).cast("binary")))


class SearchIndex:
    """Postings below ``folder`` of the texts of a table by ``key``; ``folders`` deals them, and grows with the table."""

    def __init__(self, spark: SparkSession, folder: str, key: str, text: str, folders: int = FOLDERS):
        self.spark, self.root, self.key, self.text, self.folders = spark, folder.rstrip("/"), key, text, folders

    def _dealt(self, trigram: str) -> Column:
        return F.pmod(F.xxhash64(trigram), F.lit(self.folders)).cast("int")

    def build(self, rows: DataFrame) -> None:
        """Write the postings of the texts of (key, text); they replace those before.

        A frequent trigram's postings are dealt over several tasks and files of its folder.
        """
        made = self._texts(rows).select("_id", F.explode(trigrams(F.col("_text"))).alias("trigram")).withColumn("_folder", self._dealt("trigram"))
        dealt = made.repartition("_folder", F.pmod(F.xxhash64("_id"), F.lit(8)))
        dealt.sortWithinPartitions("_folder", "trigram").write.mode("overwrite").partitionBy("_folder").parquet(f"{self.root}/postings")
        counts = self._postings().groupBy("_folder", "trigram").agg(F.count("*").alias("rows"))
        counts.repartition("_folder").write.mode("overwrite").partitionBy("_folder").parquet(f"{self.root}/counts")

    def _texts(self, rows: DataFrame) -> DataFrame:
        """(_id, _text): the distinct lower-cased texts."""
        return rows.where(F.col(self.text).isNotNull()).groupBy(text_id(F.col(self.text)).alias("_id")).agg(F.first(F.lower(self.text)).alias("_text"))

    def _postings(self) -> DataFrame:
        return self.spark.read.schema("_id binary, trigram string, _folder int").parquet(f"{self.root}/postings")

    def _counts(self) -> DataFrame:
        return self.spark.read.schema("trigram string, rows long, _folder int").parquet(f"{self.root}/counts")

    def candidates(self, patterns: DataFrame) -> DataFrame:
        """(pattern, _id) of texts with all the rarest trigrams of each distinct pattern of three characters or more."""
        asked = patterns.select("pattern", F.explode(trigrams(F.col("pattern"))).alias("trigram")).withColumn("_folder", self._dealt("trigram"))
        counted = asked.join(self._counts(), ["_folder", "trigram"], "left")
        # a trigram that no text has is the rarest: nothing is found
        least = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "trigram"))), 1, RAREST)
        chosen = counted.groupBy("pattern").agg(least.alias("t")).select("pattern", F.size("t").alias("_n"), F.explode("t.trigram").alias("trigram"))
        chosen = chosen.withColumn("_folder", self._dealt("trigram"))
        hits = self._postings().join(chosen, ["_folder", "trigram"])
        return hits.groupBy("pattern", "_id").agg(F.count("*").alias("_k"), F.first("_n").alias("_n")).where("_k = _n").select("pattern", "_id")

    def search(self, rows: DataFrame, patterns: DataFrame) -> DataFrame:
        """(patternId, key) of the rows whose text contains each pattern, case ignored."""
        own = patterns.where("pattern IS NOT NULL").select("patternId", F.lower("pattern").alias("pattern"))
        asked, texts = own.select("pattern").distinct(), self._texts(rows)
        found = self.candidates(asked).join(texts, "_id").where(F.contains("_text", "pattern")).select("pattern", "_id")
        grams = texts.select("_id", F.explode(short_grams(F.col("_text"))).alias("pattern"))
        short = grams.join(asked.where(F.length("pattern") < 3), "pattern").select("pattern", "_id")
        return self._spread(found.unionByName(short).join(own, "pattern").select("patternId", "_id"), rows)

    def _spread(self, pairs: DataFrame, rows: DataFrame) -> DataFrame:
        """The rows of each (patternId, _id); those of a text are dealt by their keys, and a pair goes where the text has rows."""
        keyed = rows.where(F.col(self.text).isNotNull()).select(self.key, text_id(F.col(self.text)).alias("_id"), F.pmod(F.xxhash64(self.key), F.lit(PARTS)).cast("int").alias("_part"))
        places = keyed.select("_id", "_part").distinct()
        return pairs.join(places, "_id").join(keyed, ["_id", "_part"]).select("patternId", self.key)

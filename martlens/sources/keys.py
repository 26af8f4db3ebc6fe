"""Surrogate keys of natural ids: worked out where possible, else looked up.

An id of a dimension's own form (its letter and a number: ``C42`` of a customer)
has that number as its key. The form maps ids to numbers one to one, so no two
of these ids can meet and facts need no look-up for them. Every other id is in
the dimension's dictionary, a stored table that only grows: an id that is not in
it gets the next number below zero, and keeps it in all later builds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.operators.numbering import numbered, tagged

_ENTRY = "natural_id string, number long"


@dataclass(frozen=True)
class KeyForm:
    """How a dimension's ids carry their own numbers.

    ``pattern`` matches a whole id and captures its number. Where two ids can
    carry one number (``shared``: payment types ``1-URGENT`` and ``1-OTHER``),
    the dictionary holds all ids, and the number goes to the id that had it
    first, the lowest of those that come at once.
    """

    name: str
    pattern: str
    kind: str = "long"
    shared: bool = False

    def own(self, natural_id: Column) -> Column:
        """The number an id carries; NULL if it carries none."""
        number = F.regexp_extract(natural_id, self.pattern, 1)
        return F.nullif(number, F.lit("")).cast("long")


# The letters of the ids and the numbered payment types.
CUSTOMERS = KeyForm("pelanggan", "^C(0|[1-9][0-9]{0,17})$")
PRODUCTS = KeyForm("produk", "^P(0|[1-9][0-9]{0,17})$")
SELLERS = KeyForm("seller", "^S(0|[1-9][0-9]{0,17})$")
METHODS = KeyForm("metode", "^([1-9][0-9]{0,8})-", kind="int", shared=True)


def _hashed(form: KeyForm, natural_id: Column) -> Column:
    bits = 31 if form.kind == "int" else 63
    return -F.xxhash64(natural_id).bitwiseAND(F.lit((1 << bits) - 1)) - 1


class HashedKeys:
    """Keys without a dictionary, for sessions that have nowhere to keep one.

    Ids without a number get a hash below zero; so do all ids whose numbers
    may be shared. ``check_keys`` finds two that meet.
    """

    def learn(self, form: KeyForm, *ids: DataFrame) -> None:
        """Nothing to learn."""

    def keyed(self, df: DataFrame, form: KeyForm, natural_id: str, key: str) -> DataFrame:
        """``df`` with the key of ``natural_id`` in its place; NULL stays NULL."""
        hashed = _hashed(form, F.col(natural_id))
        own = hashed if form.shared else F.coalesce(form.own(F.col(natural_id)), hashed)
        found = F.when(F.col(natural_id).isNotNull(), own).cast(form.kind)
        return df.withColumn(key, found).drop(natural_id)


class KeyDictionary:
    """Dictionaries of all dimensions under one folder that the executors share.

    One build at a time may write to a folder; any number may read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self._folder = folder.rstrip("/")
        self._held: dict[str, bool] = {}

    def entries(self, form: KeyForm) -> DataFrame:
        """(natural_id, number) of every id that was given a number."""
        path = f"{self._folder}/{form.name}"
        self._spark.createDataFrame([], _ENTRY).write.mode("ignore").parquet(path)
        return self._spark.read.schema(_ENTRY).parquet(path)

    def learn(self, form: KeyForm, *ids: DataFrame) -> None:
        """Give a number to each id in one of the one-column tables that has none.

        Ids that are known, or carry their own number, cost no more than the
        scan that finds them. New ones are written, numbered without gathering
        them in one task, and appended.
        """
        known = self.entries(form)
        of_form = [df.toDF("natural_id").where("natural_id is not null") for df in ids]
        every = reduce(DataFrame.unionByName, of_form)
        own = form.own(F.col("natural_id"))
        if not form.shared:
            every = every.where(own.isNull())
        new = every.distinct().join(known, "natural_id", "left_anti")
        if form.shared:
            claims = self._stored(self._claims(new, own, known), f"staged/{form.name}")
            self._append(claims.where("claim is not null"), form, F.col("claim"))
            new = claims.where("claim is null").drop("claim")
        fresh = self._stored(tagged(new, "tag"), f"staged/{form.name}")
        if not fresh.isEmpty():
            used = -(known.agg(F.min("number")).first()[0] or 0)
            self._append(numbered(fresh, "tag", "n", max(used, 0)), form, -F.col("n") - 1)
        self._held[form.name] = not self.entries(form).isEmpty()

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self._folder}/{name}-{uuid4().hex}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def _append(self, ids: DataFrame, form: KeyForm, number: Column) -> None:
        entries = ids.select("natural_id", number.alias("number"))
        entries.write.mode("append").parquet(f"{self._folder}/{form.name}")

    @staticmethod
    def _claims(new: DataFrame, own: Column, known: DataFrame) -> DataFrame:
        """Ids with the number they carry, if no other id has it and no lower one wants it."""
        wanted = new.withColumn("claim", own)
        lowest = wanted.where("claim is not null").groupBy("claim")
        lowest = lowest.agg(F.min("natural_id").alias("natural_id"))
        free = lowest.join(known.select(F.col("number").alias("claim")), "claim", "left_anti")
        return new.join(free, "natural_id", "left")

    def keyed(self, df: DataFrame, form: KeyForm, natural_id: str, key: str) -> DataFrame:
        """``df`` with the key of ``natural_id`` in its place; NULL stays NULL.

        While a dictionary is empty there is nothing to join. Otherwise the
        join carries no hint: files have a size that the optimizer knows, and
        adaptive execution splits an id that holds many rows.
        """
        if form.name not in self._held:
            raise ValueError(f"{form.name}: learn the ids before using their keys")
        own = None if form.shared else form.own(F.col(natural_id))
        if own is not None and not self._held[form.name]:
            return df.withColumn(key, own.cast(form.kind)).drop(natural_id)
        entries = self.entries(form).select(
            F.col("natural_id").alias(natural_id), F.col("number").alias(key)
        )
        joined = df.join(entries, natural_id, "left")
        found = F.col(key) if own is None else F.coalesce(own, F.col(key))
        return joined.withColumn(key, found.cast(form.kind)).drop(natural_id)

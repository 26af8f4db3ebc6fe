"""All pair questions of both sides from one pass over each base table.

A row of a table is expanded to what it adds to: its product, its seller, its
month, everything. One aggregate sums that per key, with map-side combine; one
join on the keys brings the attributes of all dimensions; what results is
expanded again to the rows of the questions and summed once more. So a table is
read once, whatever number of questions use it, and a key that holds a third of
all rows is one row per task in each shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlens.functions import as_double, mean_rounded
from martlens.model import Mart, Normalized
from martlens.operators.joins import translate_category
from martlens.operators.ranking import highest_first
from martlens.plans.pairs import PAIRS, delivered

#: What a base row adds to its keys.
_SUMS = {
    "sales": "long", "qty": "long", "revenue": "decimal(28,2)", "deliveries": "long",
    "days": "long", "timed": "long", "reviews": "long", "score": "long", "scored": "long",
    "payments": "long",
}
_KEYS = {"kind": "string", "key": "string", "y": "int", "m": "int"}
_ATTRIBUTES = {"id": "string", "label": "string", "native": "string", "dim_y": "int", "dim_m": "int"}
_EXACT = "decimal(38,4)"

#: Groups of labels in which the top of a ranking is looked for first.
_RANK_GROUPS = 256
_TOP = {"q12": 10, "q13": 10, "q14": 10, "q15": 5}
#: Questions whose figure is the number of their distinct labels.
_COUNTED = ("q06", "q07")
_MEANS = ("q04", "q16")
_ROUNDED = ("q18",)


def _struct(fields: dict[str, str], given: dict[str, object]) -> Column:
    def value(name: str) -> Column:
        found = given.get(name)
        return found if isinstance(found, Column) else F.lit(found)

    return F.struct(*[value(name).cast(kind).alias(name) for name, kind in fields.items()])


def _adds(kind: str, key: Column | str | None = None, **given: Column | int | str) -> Column:
    """One key of a base row, and what the row adds to it."""
    named = {n: F.col(v) if isinstance(v, str) else v for n, v in given.items()}
    key = F.col(key) if isinstance(key, str) else key
    return _struct({**_KEYS, **_SUMS}, {"kind": kind, "key": key, **named})


def _expanded(df: DataFrame, *entries: Column) -> DataFrame:
    """The entries of all rows; an entry that is NULL adds nothing."""
    return df.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _described(df: DataFrame, kind: str, key: str, **given: str) -> DataFrame:
    """The attributes of a dimension's rows, under kind and key."""
    named = {name: F.col(column) for name, column in given.items()}
    attributes = _struct(_ATTRIBUTES, named)
    return df.select(
        F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), attributes.alias("dim")
    )


def _sums_n(n: Normalized) -> DataFrame:
    """What the normalized tables add to their keys.

    Items meet orders once. An order comes twice, as the one its items are
    sold by and as itself; the latter has no items and passes the join alone.
    Items are summed per order, product and seller first.
    """
    items = n.order_items.groupBy("order_id", "product_id", "seller_id").agg(
        F.count(F.lit(1)).alias("sold"),
        F.count("order_item_id").alias("counted"),
        F.sum("price").alias("price"),
    )
    part = F.explode(F.array(F.lit("items"), F.lit("order"))).alias("part")
    when = F.col("order_purchase_timestamp")
    orders = n.orders.select(
        "order_id", part, "customer_id", F.year(when).alias("tahun"), F.month(when).alias("bulan"),
        *[c.alias(name) for name, c in zip(("arrived", "late"), delivered(), strict=True)],
        F.lit(True).alias("ordered"),
    )
    both = items.withColumn("part", F.lit("items")).join(orders, ["order_id", "part"], "full")
    item, ordered, sold = F.col("sold").isNotNull(), F.col("ordered").isNotNull(), F.col("sold")
    brought = F.col("arrived") & ordered
    days = F.when(brought, F.col("late") * sold)
    trips = F.when(brought, sold)
    facts = _expanded(
        both,
        F.when(item, _adds(
            "product", "product_id", sales="sold", qty="counted", revenue="price",
            deliveries=trips, days=days, timed=trips,
        )),
        F.when(item, _adds("seller", "seller_id", sales="sold", revenue="price")),
        F.when(item, _adds("total", sales="sold", qty="sold", revenue="price")),
        F.when(item & ordered, _adds("month", y="tahun", m="bulan", sales="sold", revenue="price")),
        F.when(item & ordered, _adds("customer", "customer_id", sales="sold", revenue="price")),
        F.when((F.col("part") == "order") & F.col("arrived"), _adds(
            "customer", "customer_id", deliveries=F.lit(1), days="late", timed=F.lit(1)
        )),
    )
    paid = _expanded(n.order_payments, _adds("method", "payment_type", payments=F.lit(1)))
    score = F.col("review_score")
    rated = _expanded(n.order_reviews, _adds(
        "year", y=F.year("review_creation_date"), reviews=F.lit(1), score="review_score",
        scored=F.when(score.isNotNull(), 1).otherwise(0),
    ))
    return _union([facts, paid, rated])


def _attributes_n(n: Normalized) -> DataFrame:
    english = "product_category_name_english"
    products = translate_category(n.products, n.product_category_translation)
    return _union([
        _described(products, "product", "product_id", id="product_id", label=english, native=english),
        _described(n.customers, "customer", "customer_id", id="customer_id", label="customer_state"),
    ])


def _sums_s(m: Mart) -> DataFrame:
    """What the facts add to the keys of their dimensions."""
    one = F.lit(1)
    money = {"sales": one, "revenue": "total_harga"}
    sales = _expanded(
        m.fakta_penjualan,
        _adds("product", "produk_key", **money, qty="jumlah"),
        _adds("seller", "seller_key", **money),
        _adds("customer", "pelanggan_key", **money),
        _adds("day", "waktu_id", **money),
        _adds("total", **money, qty="jumlah"),
    )
    timed = F.when(F.col("durasi_pengiriman").isNotNull(), 1).otherwise(0)
    trip = {"deliveries": one, "days": "durasi_pengiriman", "timed": timed}
    brought = _expanded(
        m.fakta_pengiriman,
        _adds("product", "produk_key", **trip),
        _adds("customer", "pelanggan_key", **trip),
    )
    paid = _expanded(m.fakta_pembayaran, _adds("method", "metode_key", payments=one))
    scored = F.when(F.col("skor_review").isNotNull(), 1).otherwise(0)
    rated = _expanded(
        m.fakta_review, _adds("day", "waktu_id", reviews=one, score="skor_review", scored=scored)
    )
    return _union([sales, brought, paid, rated])


def _attributes_s(m: Mart) -> DataFrame:
    return _union([
        _described(m.dim_produk, "product", "produk_key", id="produk_id", label="kategori_inggris", native="kategori"),
        _described(m.dim_pelanggan, "customer", "pelanggan_key", id="pelanggan_id", label="state"),
        _described(m.dim_seller, "seller", "seller_key", id="seller_id"),
        _described(m.dim_metode_pembayaran, "method", "metode_key", id="metode_pembayaran"),
        _described(m.dim_waktu, "day", "waktu_id", dim_y="tahun", dim_m="bulan"),
    ])


def _known(sums: DataFrame, attributes: DataFrame) -> DataFrame:
    """Sums per key with the attributes of the key; either may be missing."""
    summed = sums.groupBy(*_KEYS).agg(*[F.sum(name).alias(name) for name in _SUMS])
    return summed.join(attributes, ["kind", "key"], "full")


def _row(pair: str, when: Column, key: dict[str, Column], a: Column, b: Column | None = None,
         label: Column | None = None) -> Column:
    """What a key's sums add to a row of a question."""
    named = F.struct(*[value.alias(name) for name, value in key.items()])
    text = F.to_json(named, {"ignoreNullFields": "false"}) if key else F.lit("{}")
    fields = {"pair": "string", "k": "string", "label": "string", "a": _EXACT, "b": _EXACT}
    values = {"pair": pair, "k": text, "label": label, "a": a, "b": b}
    return F.when(when, _struct(fields, values))


def _questions(known: DataFrame, side: str) -> DataFrame:
    """(pair, k, label, a, b): rows of all questions, still to be summed."""
    star = side == "star"
    kind, dim = F.col("kind"), F.col("dim").isNotNull()
    named = F.col("dim.id") if star else F.col("key")
    sold, brought, rated = (F.col(c).isNotNull() for c in ("sales", "deliveries", "reviews"))
    # The normalized side names products, sellers and customers without a look-up.
    found = dim if star else F.lit(True)
    qty, revenue, one = F.col("qty"), F.col("revenue"), F.lit(1)
    state = F.col("dim.label")
    year, month = (F.col("dim.dim_y"), F.col("dim.dim_m")) if star else (F.col("y"), F.col("m"))
    product, customer = kind == "product", kind == "customer"
    by_month, by_year = ((kind == "day",) * 2) if star else (kind == "month", kind == "year")
    units = qty if star else F.col("sales")
    paid = (kind == "method") & F.col("payments").isNotNull() & found
    times = {"tahun": year, "bulan": month}
    rows = [
        _row("q01", by_month & sold & found, times, revenue),
        _row("q02", product & sold & dim, {"kategori": state}, qty, revenue),
        _row("q03", customer & dim, {"state": state}, one),
        _row("q04", product & brought & dim, {"kategori": F.col("dim.native")}, F.col("days"), F.col("timed")),
        _row("q05", customer & dim, {}, one),
        _row("q06", product & dim & F.col("key").isNotNull(), {}, one, label=F.col("key")),
        _row("q07", product & dim & state.isNotNull(), {}, one, label=state),
        _row("q08", kind == "total", {}, qty),
        _row("q09", kind == "total", {}, revenue),
        _row("q11", paid, {"metode_pembayaran": named}, F.col("payments")),
        _row("q12", product & sold & found, {"product_id": named}, units, label=named),
        _row("q13", (kind == "seller") & sold & found, {"seller_id": named}, revenue, label=named),
        _row("q14", customer & sold & found, {"customer_id": named}, revenue, label=named),
        _row("q15", customer & dim, {"state": state}, one, label=state),
        _row("q16", customer & brought & dim, {"state": state}, F.col("days"), F.col("timed")),
        _row("q18", by_year & rated & found, {"tahun": year}, F.col("score"), F.col("scored")),
    ]
    return _expanded(known, *rows).withColumn("side", F.lit(side))


def _figures_of_nothing(df: DataFrame) -> DataFrame:
    """Figures have a row also where there is nothing: a count of 0, a sum that is NULL."""
    none, always = F.lit(None).cast(_EXACT), F.lit(True)
    zero = {"normalized": ["q05", "q06", "q07", "q08"], "star": ["q05", "q06", "q07"]}
    null = {"normalized": ["q09"], "star": ["q08", "q09"]}
    base = df.sparkSession.range(1)
    parts = [
        _expanded(
            base,
            *[_row(pair, always, {}, F.lit(0)) for pair in zero[side]],
            *[_row(pair, always, {}, none) for pair in null[side]],
        ).withColumn("side", F.lit(side))
        for side in zero
    ]
    return _union(parts)


def _answers(rows: DataFrame) -> DataFrame:
    """Each question's rows with a and b summed, top-k questions cut to their top."""
    group = ["side", "pair", "k"]
    summed = rows.groupBy(*group, "label").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counted = F.col("pair").isin(*_COUNTED)
    each = F.when(counted, F.col("label").isNotNull().cast("int").cast(_EXACT)).otherwise(F.col("a"))
    kept_label = F.when(~counted, F.col("label")).alias("label")
    figures = summed.groupBy(*group, kept_label).agg(F.sum(each).alias("a"), F.sum("b").alias("b"))
    limit = F.lit(None).cast("int")
    for pair, k in _TOP.items():
        limit = F.when(F.col("pair") == pair, k).otherwise(limit)
    best = highest_first("a", "label")
    some = F.pmod(F.hash("label"), F.lit(_RANK_GROUPS))
    for by in (["side", "pair", some], ["side", "pair"]):
        # First within groups of labels, so that no task orders all of a ranking.
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*best))
        figures = figures.withColumn("place", place).where(limit.isNull() | (F.col("place") <= limit))
    return figures.drop("place", "label")


def shared_cells(n: Normalized, m: Mart) -> DataFrame:
    """(pair, key, measure, first, side, exact, value) of all pairs, each base table read once.

    Questions that are asked under two names have rows under the first only.
    """
    sides = {
        "normalized": _known(_sums_n(n), _attributes_n(n)),
        "star": _known(_sums_s(m), _attributes_s(m)),
    }
    asked = [_questions(known, side) for side, known in sides.items()]
    rows = _union([*asked, _figures_of_nothing(asked[0])])
    answers = _answers(rows)
    pair, a, b = F.col("pair"), F.col("a"), F.col("b")
    whole = {"a": a.cast("long"), "b": b.cast("long")}
    mean = as_double(whole["a"]) / F.when(whole["b"] > 0, whole["b"])
    rounded = as_double(mean_rounded(whole["a"], whole["b"]))
    inexact = pair.isin(*_MEANS, *_ROUNDED)
    value = F.when(pair.isin(*_MEANS), mean).when(pair.isin(*_ROUNDED), rounded)
    names = F.lit(None).cast("string")
    for name, of in PAIRS.items():
        names = F.when(pair == name, of.measures[0]).otherwise(names)

    def cell(measure: Column, first: bool, exact: Column, shown: Column) -> Column:
        return F.struct(
            measure.alias("measure"), F.lit(first).alias("first"), exact.alias("exact"), shown.alias("value")
        )

    cells = F.array(
        cell(names, True, F.when(~inexact, a), F.when(inexact, value).otherwise(a.cast("double"))),
        F.when(pair == "q02", cell(F.lit(PAIRS["q02"].measures[1]), False, b, b.cast("double"))),
    )
    told = answers.withColumn("cell", F.explode(F.filter(cells, lambda c: c.isNotNull())))
    return told.select("pair", F.col("k").alias("key"), "cell.*", "side")

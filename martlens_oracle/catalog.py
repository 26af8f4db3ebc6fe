"""The SQL of each registered query."""

from __future__ import annotations

from martlens_oracle.tables import with_tables
from martlens_oracle.texts import with_text

PERIODS: dict[str, tuple[int | None, int | None]] = {
    "all": (None, None),
    "y": (1997, None),
    "m": (None, 3),
    "ym": (1997, 3),
}


def _where(period: str) -> str:
    year, month = PERIODS[period]
    tests = [f"w.tahun = {year}"] if year else []
    tests += [f"w.bulan = {month}"] if month else []
    return f"WHERE {' AND '.join(tests)}" if tests else ""


def _facts(table: str, period: str, joins: str = "") -> str:
    return f"FROM {table} f JOIN dim_waktu w USING (waktu_id) {joins} {_where(period)}"


def _mean2(total: str, n: str) -> str:
    """Mean rounded half up to two places, by whole-number division."""
    hundredths = f"(200 * CAST({total} AS HUGEINT) + {n}) // (2 * {n})"
    return f"CAST({hundredths} AS DOUBLE) / 100"


def _percent1(part: str, whole: str) -> str:
    """Percentage rounded half up to one place, by whole-number division."""
    return f"CAST((2000 * CAST({part} AS HUGEINT) + {whole}) // (2 * {whole}) AS DOUBLE) / 10"


def _qty(column: str = "jumlah") -> str:
    return f"CAST(sum({column}) AS BIGINT)"


_PLACE = "CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS pos"


def _ranked(totals: str, measure: str, k: int, nulls: str = "FIRST") -> str:
    order = f"{measure} DESC NULLS {nulls}, label ASC NULLS LAST"
    return f"SELECT {_PLACE.format(order=order)}, * FROM ({totals}) ORDER BY pos LIMIT {k}"


# Tables of both models.


def _model_tables() -> dict[str, str]:
    plain = ["dim_waktu", "dim_pelanggan", "dim_produk", "dim_seller", "dim_metode_pembayaran",
             "fakta_pengiriman", "fakta_pembayaran", "fakta_review"]
    sql = {f"mart_{name}": with_tables(f"SELECT * FROM {name}") for name in plain}
    sql["mart_fakta_penjualan"] = with_tables(
        "SELECT * REPLACE (CAST(total_harga AS DOUBLE) AS total_harga) FROM fakta_penjualan"
    )
    for name in ["orders", "products", "customers",
                 "order_payments", "order_reviews"]:
        sql[f"norm_{name}"] = with_tables(f"SELECT * FROM n_{name}")
    sql["norm_order_items"] = with_tables(
        "SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM n_order_items"
    )
    return sql


# Filter choices and headline figures.


def _items_sold(period: str) -> str:
    return f"SELECT coalesce({_qty()}, 0) AS items_sold {_facts('fakta_penjualan', period)}"


_REVENUE_ALL = (
    "SELECT CAST(coalesce(sum(total_harga), 0) AS DOUBLE) AS total_revenue FROM fakta_penjualan"
)
_REVENUE_YEAR = (
    "SELECT CAST(coalesce(sum(total_harga), 0) AS DOUBLE) AS total_revenue "
    + _facts("fakta_penjualan", "y")
)
_AVG_DELIVERY = (
    f"SELECT {_mean2('sum(durasi_pengiriman)', 'count(durasi_pengiriman)')} "
    "AS avg_delivery_days FROM fakta_pengiriman"
)


def _figures() -> dict[str, str]:
    sql = {
        "available_years": "SELECT DISTINCT tahun FROM dim_waktu ORDER BY tahun DESC",
        "available_months_all": "SELECT DISTINCT bulan FROM dim_waktu ORDER BY bulan",
        "available_months_y": """
            SELECT DISTINCT bulan FROM dim_waktu WHERE tahun = 1997 ORDER BY bulan""",
        "month_options": """
            SELECT DISTINCT bulan, nama_bulan FROM dim_waktu LEFT JOIN month_names USING (bulan)
            ORDER BY bulan""",
        "kpi_customers": "SELECT count(*) AS total_customers FROM dim_pelanggan",
        "kpi_products": "SELECT count(*) AS total_products FROM dim_produk",
        "kpi_categories": "SELECT count(DISTINCT kategori) AS total_categories FROM dim_produk",
        "kpi_revenue_all": _REVENUE_ALL,
        "kpi_revenue_y": _REVENUE_YEAR,
        "kpi_avg_delivery": _AVG_DELIVERY,
    }
    sql |= {
        f"kpi_sheet_{p}": f"""
            SELECT (SELECT count(*) FROM dim_pelanggan) AS total_customers,
                   (SELECT count(*) FROM dim_produk) AS total_products,
                   (SELECT count(DISTINCT kategori) FROM dim_produk) AS total_categories,
                   ({_items_sold(p)}) AS items_sold,
                   ({_REVENUE_YEAR if 'y' in p else _REVENUE_ALL}) AS total_revenue,
                   ({_AVG_DELIVERY}) AS avg_delivery_days"""
        for p in PERIODS
    }
    sql |= {f"kpi_items_sold_{p}": _items_sold(p) for p in PERIODS}
    return {name: with_tables(text) for name, text in sql.items()}


# Series and distributions.

_SERIES_LABEL = {
    "ym": ("tanggal", "strftime(tanggal, '%-d %b')"),
    "y": ("bulan", "lpad(CAST(bulan AS VARCHAR), 2, '0')"),
    "m": ("tahun", "CAST(tahun AS VARCHAR)"),
    "all": ("tahun, bulan", "tahun || '-' || lpad(CAST(bulan AS VARCHAR), 2, '0')"),
}


def _series_points(period: str) -> str:
    keys, label = _SERIES_LABEL[period]
    return f"""
        SELECT {_PLACE.format(order=keys)}, {label} AS label,
               sum(total_harga) AS revenue, {_qty()} AS qty
        {_facts('fakta_penjualan', period)} GROUP BY {keys}"""


def _payment(period: str) -> str:
    joined = _facts("fakta_pembayaran", period, "JOIN dim_metode_pembayaran d USING (metode_key)")
    return f"SELECT metode_pembayaran, count(*) AS jumlah {joined} GROUP BY 1"


_MEAN_DAYS = _mean2("sum(durasi_pengiriman)", "count(durasi_pengiriman)")


def _delivery_state(period: str) -> str:
    joined = _facts("fakta_pengiriman", period, "JOIN dim_pelanggan d USING (pelanggan_key)")
    return f"SELECT state, {_MEAN_DAYS} AS avg_delivery_days {joined} GROUP BY 1"


def _delivery_category(period: str) -> str:
    joined = _facts("fakta_pengiriman", period, "JOIN dim_produk d USING (produk_key)")
    return f"""SELECT kategori_inggris AS kategori, count(*) AS shipments,
                      {_MEAN_DAYS} AS avg_delivery_days {joined} GROUP BY 1"""


def _rating(period: str, by: str) -> str:
    label = "CAST(tahun AS VARCHAR)"
    if by == "month":
        label += " || '-' || lpad(CAST(bulan AS VARCHAR), 2, '0')"
    means = f"""SELECT {label} AS label, {_mean2('sum(skor_review)', 'count(skor_review)')}
                       AS avg_rating {_facts('fakta_review', period)} GROUP BY 1"""
    return f"SELECT {_PLACE.format(order='label')}, * FROM ({means})"


def _distributions() -> dict[str, str]:
    sql = {
        f"sales_series_{p}": f"""
            SELECT pos, label, CAST(revenue AS DOUBLE) AS revenue, qty
            FROM ({_series_points(p)}) ORDER BY pos"""
        for p in PERIODS
    }
    for p in PERIODS:
        sql[f"payment_methods_{p}"] = _payment(p)
        sql[f"delivery_by_state_{p}"] = _delivery_state(p)
        sql[f"delivery_by_category_{p}"] = _delivery_category(p)
        sql[f"rating_by_year_{p}"] = _rating(p, "year")
        sql[f"rating_by_month_{p}"] = _rating(p, "month")
    return {name: with_tables(text) for name, text in sql.items()}


# Leaderboards, segments, map.


def _top_items(period: str, label: str) -> str:
    joined = _facts("fakta_penjualan", period, "JOIN dim_produk d USING (produk_key)")
    return _ranked(f"SELECT {label} AS label, {_qty()} AS total_qty {joined} GROUP BY 1",
                   "total_qty", 10)


def _sellers(period: str) -> str:
    joined = _facts("fakta_penjualan", period, "JOIN dim_seller d USING (seller_key)")
    return f"""SELECT seller_id AS label, {_qty()} AS total_qty,
                      sum(total_harga) AS total_revenue {joined} GROUP BY 1"""


def _customers(period: str) -> str:
    joined = _facts("fakta_penjualan", period, "LEFT JOIN dim_pelanggan d USING (pelanggan_key)")
    return f"""SELECT coalesce(pelanggan_id, CAST(pelanggan_key AS VARCHAR)) AS label,
                      {_qty()} AS total_qty, sum(total_harga) AS total_revenue {joined}
               GROUP BY 1"""


_TOP_STATES = _ranked(
    "SELECT state AS label, count(*) AS total_customers FROM dim_pelanggan "
    "WHERE state IS NOT NULL AND state <> '' GROUP BY 1",
    "total_customers",
    5,
)


def _money_text(value: str) -> str:
    cents = f"CAST({value} * 100 AS BIGINT)"
    whole = f"replace(format('{{:,}}', {cents} // 100), ',', '.')"
    return f"'R$ ' || {whole} || ',' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0')"


def _segments(totals: str, entity: str, id_column: str) -> str:
    return f"""
        SELECT pos, label AS {id_column}, tier, total_qty,
               CAST(total_revenue AS DOUBLE) AS total_revenue,
               {_money_text('total_revenue')} AS revenue_text, benefit
        FROM (SELECT *, CASE WHEN pos < 4 THEN 'Gold' WHEN pos < 7 THEN 'Silver'
                             ELSE 'Bronze' END AS tier
              FROM ({_ranked(totals, 'total_revenue', 10)}))
        JOIN (SELECT tier, benefit FROM benefits WHERE entity = '{entity}') USING (tier)"""


def _placed(dim: str) -> str:
    return f"""
        SELECT c.state, nama, jumlah, lat, lng, max(jumlah) OVER () AS max_jumlah
        FROM (SELECT trim(state) AS code, n AS jumlah
              FROM (SELECT state, count(*) AS n FROM {dim}
                    WHERE state IS NOT NULL AND state <> '' GROUP BY state))
        JOIN state_coords c ON c.state = code"""


def _scaled(dim: str) -> str:
    return f"""
        SELECT state, nama, jumlah, lat, lng,
               15000.0::DOUBLE + s * 185000.0::DOUBLE AS radius,
               CAST(floor(6.0::DOUBLE + s * 12.0::DOUBLE + 0.5) AS INTEGER) AS pixel_radius,
               CASE WHEN jumlah / max_jumlah >= 0.66::DOUBLE THEN '#e74c3c'
                    WHEN jumlah / max_jumlah >= 0.33::DOUBLE THEN '#f1c40f'
                    ELSE '#2ecc71' END AS color
        FROM (SELECT *, sqrt(CASE WHEN max_jumlah = low THEN 0.5::DOUBLE
                                  ELSE (jumlah - low) / (max_jumlah - low) END) AS s
              FROM (SELECT *, min(jumlah) OVER () AS low FROM ({_placed(dim)})))"""


def _document(dim: str, kind: str) -> str:
    return f"""
        SELECT CAST(to_json({{
                 'tipe': '{kind}',
                 'data': list({{'state': state, 'nama': nama, 'jumlah': jumlah,
                               'lat': lat, 'lng': lng}} ORDER BY jumlah DESC, state),
                 'max': max(jumlah)}}) AS VARCHAR) AS document
        FROM ({_placed(dim)})"""


def _boards() -> dict[str, str]:
    sql = {"top_states": _TOP_STATES}
    for p in PERIODS:
        sql[f"top_products_{p}"] = _top_items(p, "produk_id")
        sql[f"top_categories_{p}"] = _top_items(p, "kategori_inggris")
        by_qty = _ranked(_sellers(p), "total_qty", 10, "LAST")
        by_revenue = _ranked(_sellers(p), "total_revenue", 10, "LAST")
        money = "CAST(total_revenue AS DOUBLE) AS total_revenue"
        sql[f"top_sellers_qty_{p}"] = f"SELECT pos, label, total_qty FROM ({by_qty})"
        sql[f"top_sellers_revenue_{p}"] = f"SELECT pos, label, {money} FROM ({by_revenue})"
        sql[f"top_sellers_both_{p}"] = f"""
            SELECT 'total_qty' AS ranking, pos, label, total_qty, {money} FROM ({by_qty})
            UNION ALL
            SELECT 'total_revenue', pos, label, total_qty, {money} FROM ({by_revenue})"""
        customers = _ranked(_customers(p), "total_revenue", 10)
        sql[f"top_customers_{p}"] = f"SELECT pos, label, {money} FROM ({customers})"
        sql[f"segment_customers_{p}"] = _segments(_customers(p), "customer", "pelanggan_id")
        sql[f"segment_sellers_{p}"] = _segments(_sellers(p), "seller", "seller_id")
    sql["chart_top_customers"] = f"""
        SELECT pos, CASE WHEN length(label) > 4 THEN left(label, 2) || '…' ELSE label END
               AS short_label, {_money_text('total_revenue')} AS revenue_text
        FROM ({_ranked(_customers('all'), 'total_revenue', 10)})"""
    for entity, dim, kind in [("customer", "dim_pelanggan", "pelanggan"),
                              ("seller", "dim_seller", "seller")]:
        sql[f"state_distribution_{entity}"] = _placed(dim)
        sql[f"map_scale_{entity}"] = _scaled(dim)
        sql[f"state_distribution_json_{entity}"] = _document(dim, kind)
    sql["chart_json_top_products"] = f"""
        SELECT CAST(to_json({{'label': list(label ORDER BY pos),
                             'total_qty': list(total_qty ORDER BY pos)}}) AS VARCHAR) AS document
        FROM ({_top_items('all', 'produk_id')})"""
    return {name: with_tables(text) for name, text in sql.items()}


# Insights.


def _insight_revenue(period: str) -> str:
    return with_tables(
        """
        SELECT n AS n_points,
               CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'multi' END AS status,
               CASE WHEN last > prev THEN 'up' WHEN last < prev THEN 'down'
                    WHEN last = prev THEN 'flat' END AS trend,
               CASE WHEN n = 1 THEN 'limited' WHEN last * n >= total THEN 'strong'
                    WHEN n > 1 THEN 'weak' END AS outlook,
               last_label, CAST(last AS DOUBLE) AS last_revenue,
               CAST(prev AS DOUBLE) AS prev_revenue, CAST(total AS DOUBLE) / n AS mean_revenue,
               (SELECT label FROM points ORDER BY revenue DESC, pos LIMIT 1) AS max_label,
               (SELECT CAST(max(revenue) AS DOUBLE) FROM points) AS max_revenue,
               (SELECT label FROM points ORDER BY revenue, pos LIMIT 1) AS min_label,
               (SELECT CAST(min(revenue) AS DOUBLE) FROM points) AS min_revenue
        FROM (SELECT (SELECT count(*) FROM points) AS n, (SELECT sum(revenue) FROM points) AS total,
                     (SELECT label FROM points ORDER BY pos DESC LIMIT 1) AS last_label,
                     (SELECT revenue FROM points ORDER BY pos DESC LIMIT 1) AS last,
                     (SELECT revenue FROM points ORDER BY pos DESC LIMIT 1 OFFSET 1) AS prev)""",
        points=_series_points(period),
    )


def _insight_payment(period: str) -> str:
    return with_tables(
        f"""
        SELECT n AS n_methods, total, top_method, top_count, second_method,
               {_percent1('top_count', 'total')} AS top_share,
               CASE WHEN total = 0 THEN 'none'
                    WHEN {_percent1('top_count', 'total')} >= 70 THEN 'dominant'
                    ELSE 'open' END AS status
        FROM (SELECT (SELECT count(*) FROM methods) AS n,
                     (SELECT CAST(coalesce(sum(jumlah), 0) AS BIGINT) FROM methods) AS total,
                     (SELECT metode_pembayaran FROM ranked WHERE pos = 1) AS top_method,
                     (SELECT jumlah FROM ranked WHERE pos = 1) AS top_count,
                     (SELECT metode_pembayaran FROM ranked WHERE pos = 2) AS second_method)""",
        methods=_payment(period),
        ranked=f"""SELECT {_PLACE.format(order='jumlah DESC, metode_pembayaran')}, *
                   FROM methods""",
    )


def _insight_items(period: str, label: str) -> str:
    share = _percent1("top_qty", "total_qty")
    gap = f"CASE WHEN second_qty > 0 THEN {_percent1('(top_qty - second_qty)', 'second_qty')} END"
    return with_tables(
        f"""
        SELECT n AS n_items, total_qty, top_label, top_qty, second_label, second_qty,
               CASE WHEN total_qty > 0 THEN {share} ELSE 0 END AS top_share, {gap} AS gap,
               CASE WHEN {gap} >= 20 THEN 'lead' WHEN {gap} < 20 THEN 'tight' END AS race,
               CASE WHEN n = 0 THEN 'none' WHEN {share} >= 50 THEN 'dominant'
                    WHEN {share} >= 30 THEN 'leading' ELSE 'even' END AS status
        FROM (SELECT count(*) AS n, CAST(sum(total_qty) AS BIGINT) AS total_qty,
                     max(label) FILTER (pos = 1) AS top_label,
                     max(total_qty) FILTER (pos = 1) AS top_qty,
                     max(label) FILTER (pos = 2) AS second_label,
                     coalesce(max(total_qty) FILTER (pos = 2), 0) AS second_qty
              FROM shown)""",
        shown=_top_items(period, label),
    )


def _insight_concentration(shown: str, measure: str, advice: str | None = None) -> str:
    by_share = "CASE WHEN 2 * top >= total THEN 'focus' ELSE 'broaden' END"
    action = f"'{advice}'" if advice else by_share
    lead = "100 * (top - second) >= 20 * second"
    return with_tables(
        f"""
        SELECT n AS n_shown, CAST(total AS DOUBLE) AS total, top_label,
               CAST(top AS DOUBLE) AS top_value, CAST(second AS DOUBLE) AS second_value,
               CASE WHEN total > 0 THEN CAST(top AS DOUBLE) / CAST(total AS DOUBLE) * 100
                    ELSE 0 END AS top_share,
               CASE WHEN second > 0
                    THEN CAST(top - second AS DOUBLE) / CAST(second AS DOUBLE) * 100 END AS gap,
               CASE WHEN second > 0 THEN CASE WHEN {lead} THEN 'lead' ELSE 'tight' END END AS race,
               CASE WHEN n = 0 THEN 'none' WHEN total > 0 AND 2 * top >= total THEN 'concentrated'
                    WHEN second > 0 AND {lead} THEN 'leading' ELSE 'balanced' END AS status,
               {action} AS action
        FROM (SELECT count(*) AS n, sum({measure}) AS total,
                     max(label) FILTER (pos = 1) AS top_label,
                     max({measure}) FILTER (pos = 1) AS top,
                     coalesce(max({measure}) FILTER (pos = 2), 0) AS second
              FROM shown)""",
        shown=shown,
    )


def _insight_delivery(means: str, label: str) -> str:
    hundredths = "CAST(round(avg_delivery_days * 100) AS BIGINT)"
    return with_tables(
        f"""
        SELECT n AS n_groups, max_label, high / 100 AS max_days, min_label, low / 100 AS min_days,
               (high - low) / 100 AS range_days,
               CASE WHEN n = 0 THEN 'none' WHEN high >= 1000 THEN 'slow'
                    WHEN high - low >= 300 THEN 'varied' ELSE 'consistent' END AS status,
               CASE WHEN high - low >= 300 THEN 'improve' WHEN n > 0 THEN 'maintain' END AS action
        FROM (SELECT (SELECT count(*) FROM means) AS n,
                     (SELECT {label} FROM means
                      ORDER BY avg_delivery_days DESC, {label} NULLS LAST LIMIT 1) AS max_label,
                     (SELECT max({hundredths}) FROM means) AS high,
                     (SELECT {label} FROM means
                      ORDER BY avg_delivery_days, {label} NULLS LAST LIMIT 1) AS min_label,
                     (SELECT min({hundredths}) FROM means) AS low)""",
        means=means,
    )


_EXTREMES = """
    (SELECT label FROM points ORDER BY avg_rating DESC, pos LIMIT 1) AS best_label,
    (SELECT max(avg_rating) FROM points) AS best_rating,
    (SELECT label FROM points ORDER BY avg_rating, pos LIMIT 1) AS worst_label,
    (SELECT min(avg_rating) FROM points) AS worst_rating"""


def _insight_rating_year(period: str) -> str:
    return with_tables(
        f"""
        SELECT n AS n_years, CAST(cents AS DOUBLE) / 100 / n AS mean_rating, {_EXTREMES},
               CASE WHEN n = 0 THEN 'none' WHEN cents >= 420 * n THEN 'strong'
                    WHEN cents >= 350 * n THEN 'middle' ELSE 'low' END AS status,
               CASE WHEN cents >= 420 * n THEN 'maintain' WHEN n > 0 THEN 'improve' END AS action
        FROM (SELECT count(*) AS n, sum(CAST(round(avg_rating * 100) AS BIGINT)) AS cents
              FROM points)""",
        points=_rating(period, "year"),
    )


def _insight_rating_month(period: str) -> str:
    cents = "CAST(round(avg_rating * 100) AS BIGINT)"
    return with_tables(
        f"""
        SELECT n AS n_months, a / 100 AS first_rating, z / 100 AS last_rating,
               (z - a) / 100 AS change, {_EXTREMES},
               CASE WHEN z > a THEN 'up' WHEN z < a THEN 'down' WHEN z = a THEN 'flat'
                    ELSE 'none' END AS status,
               CASE WHEN z < a THEN 'review' WHEN z >= a THEN 'maintain' END AS action
        FROM (SELECT (SELECT count(*) FROM points) AS n,
                     (SELECT {cents} FROM points ORDER BY pos LIMIT 1) AS a,
                     (SELECT {cents} FROM points ORDER BY pos DESC LIMIT 1) AS z)""",
        points=_rating(period, "month"),
    )


def _insights() -> dict[str, str]:
    sql = {
        f"insight_revenue_{p}": with_text(_insight_revenue(p), "revenue", p) for p in PERIODS
    }
    sql["insight_state"] = with_text(
        _insight_concentration(_TOP_STATES, "total_customers"), "state"
    )
    for p in PERIODS:
        customers = _ranked(_customers(p), "total_revenue", 10)
        by_qty = _ranked(_sellers(p), "total_qty", 10, "LAST")
        by_revenue = _ranked(_sellers(p), "total_revenue", 10, "LAST")
        found = {
            "payment": ("payment", "", _insight_payment(p)),
            "top_product": ("top_items", "product", _insight_items(p, "produk_id")),
            "top_category": ("top_items", "category", _insight_items(p, "kategori_inggris")),
            "delivery_state": (
                "delivery_state", "", _insight_delivery(_delivery_state(p), "state")),
            "delivery_category": (
                "delivery_category", "", _insight_delivery(_delivery_category(p), "kategori")),
            "rating_year": ("rating_year", "", _insight_rating_year(p)),
            "rating_month": ("rating_month", "", _insight_rating_month(p)),
            "customer": ("customer", "", _insight_concentration(customers, "total_revenue")),
            "seller_qty": (
                "seller", "qty", _insight_concentration(by_qty, "total_qty", "keep_volume")),
            "seller_revenue": (
                "seller", "revenue",
                _insight_concentration(by_revenue, "total_revenue", "watch_revenue")),
        }
        for name, (kind, by, text) in found.items():
            sql[f"insight_{name}_{p}"] = with_text(text, kind, p, by)
    return sql


# Pairs and their reconciliation.

_DAYS_N = "datesub('day', order_purchase_timestamp, order_delivered_customer_date)"
_JOIN_PRODUCTS_N = """JOIN n_products USING (product_id)
    LEFT JOIN n_product_category_translation USING (product_category_name)"""
_REVENUE = "CAST(sum({0}) AS DOUBLE) AS total_revenue"

_MONTHLY = (
    f"""SELECT CAST(year(order_purchase_timestamp) AS INTEGER) AS tahun,
               CAST(month(order_purchase_timestamp) AS INTEGER) AS bulan,
               {_REVENUE.format('price')}
        FROM n_orders JOIN n_order_items USING (order_id) GROUP BY 1, 2""",
    f"""SELECT tahun, bulan, {_REVENUE.format('total_harga')}
        FROM fakta_penjualan JOIN dim_waktu USING (waktu_id) GROUP BY 1, 2""",
)
_DELIVERY_CATEGORY = (
    f"""SELECT product_category_name_english AS kategori, avg({_DAYS_N}) AS avg_delivery_days
        FROM n_orders JOIN n_order_items USING (order_id) {_JOIN_PRODUCTS_N}
        WHERE order_delivered_customer_date IS NOT NULL GROUP BY 1""",
    """SELECT kategori, avg(durasi_pengiriman) AS avg_delivery_days
       FROM fakta_pengiriman JOIN dim_produk USING (produk_key) GROUP BY 1""",
)


def _states(table: str, state: str, name: str) -> str:
    return f"SELECT {state} AS state, count(*) AS {name} FROM {table} GROUP BY 1"


def _first(sql: str, measure: str, label: str, k: int) -> str:
    return f"{sql} ORDER BY {measure} DESC NULLS FIRST, {label} ASC NULLS LAST LIMIT {k}"


# Per pair: keys, measures, normalized SQL, star SQL.
_PAIRS: dict[str, tuple[list[str], list[str], str, str]] = {
    "q01": (["tahun", "bulan"], ["total_revenue"], *_MONTHLY),
    "q02": (
        ["kategori"],
        ["total_qty", "total_revenue"],
        f"""SELECT product_category_name_english AS kategori, count(order_item_id) AS total_qty,
                   {_REVENUE.format('price')}
            FROM n_order_items {_JOIN_PRODUCTS_N} GROUP BY 1""",
        f"""SELECT kategori_inggris AS kategori, {_qty()} AS total_qty,
                   {_REVENUE.format('total_harga')}
            FROM fakta_penjualan JOIN dim_produk USING (produk_key) GROUP BY 1""",
    ),
    "q03": (
        ["state"],
        ["total_customers"],
        _states("n_customers", "customer_state", "total_customers"),
        _states("dim_pelanggan", "state", "total_customers"),
    ),
    "q04": (["kategori"], ["avg_delivery_days"], *_DELIVERY_CATEGORY),
    "q05": (
        [],
        ["total_pelanggan"],
        "SELECT count(*) AS total_pelanggan FROM n_customers",
        "SELECT count(*) AS total_pelanggan FROM dim_pelanggan",
    ),
    "q06": (
        [],
        ["total_produk"],
        "SELECT count(DISTINCT product_id) AS total_produk FROM n_products",
        "SELECT count(*) AS total_produk FROM dim_produk",
    ),
    "q07": (
        [],
        ["total_kategori"],
        """SELECT count(DISTINCT product_category_name_english) AS total_kategori
           FROM n_products LEFT JOIN n_product_category_translation
                USING (product_category_name)""",
        "SELECT count(DISTINCT kategori_inggris) AS total_kategori FROM dim_produk",
    ),
    "q08": (
        [],
        ["total_produk_terjual"],
        "SELECT count(*) AS total_produk_terjual FROM n_order_items",
        f"SELECT {_qty()} AS total_produk_terjual FROM fakta_penjualan",
    ),
    "q09": (
        [],
        ["total_revenue"],
        f"SELECT {_REVENUE.format('price')} FROM n_order_items",
        f"SELECT {_REVENUE.format('total_harga')} FROM fakta_penjualan",
    ),
    "q10": (["tahun", "bulan"], ["total_revenue"], *_MONTHLY),
    "q11": (
        ["metode_pembayaran"],
        ["jumlah_penggunaan"],
        """SELECT payment_type AS metode_pembayaran, count(*) AS jumlah_penggunaan
           FROM n_order_payments GROUP BY 1""",
        """SELECT metode_pembayaran, count(*) AS jumlah_penggunaan
           FROM fakta_pembayaran JOIN dim_metode_pembayaran USING (metode_key) GROUP BY 1""",
    ),
    "q12": (
        ["product_id"],
        ["jumlah_terjual"],
        _first(
            "SELECT product_id, count(*) AS jumlah_terjual FROM n_order_items GROUP BY 1",
            "jumlah_terjual",
            "product_id",
            10,
        ),
        _first(
            f"""SELECT produk_id AS product_id, {_qty()} AS jumlah_terjual
                FROM fakta_penjualan JOIN dim_produk USING (produk_key) GROUP BY 1""",
            "jumlah_terjual",
            "product_id",
            10,
        ),
    ),
    "q13": (
        ["seller_id"],
        ["total_revenue"],
        _first(
            f"SELECT seller_id, {_REVENUE.format('price')} FROM n_order_items GROUP BY 1",
            "total_revenue",
            "seller_id",
            10,
        ),
        _first(
            f"""SELECT seller_id, {_REVENUE.format('total_harga')}
                FROM fakta_penjualan JOIN dim_seller USING (seller_key) GROUP BY 1""",
            "total_revenue",
            "seller_id",
            10,
        ),
    ),
    "q14": (
        ["customer_id"],
        ["total_revenue"],
        _first(
            f"""SELECT customer_id, {_REVENUE.format('price')}
                FROM n_orders JOIN n_order_items USING (order_id) GROUP BY 1""",
            "total_revenue",
            "customer_id",
            10,
        ),
        _first(
            f"""SELECT pelanggan_id AS customer_id, {_REVENUE.format('total_harga')}
                FROM fakta_penjualan JOIN dim_pelanggan USING (pelanggan_key) GROUP BY 1""",
            "total_revenue",
            "customer_id",
            10,
        ),
    ),
    "q15": (
        ["state"],
        ["total_pelanggan"],
        _first(
            _states("n_customers", "customer_state", "total_pelanggan"),
            "total_pelanggan",
            "state",
            5,
        ),
        _first(_states("dim_pelanggan", "state", "total_pelanggan"), "total_pelanggan", "state", 5),
    ),
    "q16": (
        ["state"],
        ["avg_delivery_days"],
        f"""SELECT customer_state AS state, avg({_DAYS_N}) AS avg_delivery_days
            FROM n_orders JOIN n_customers USING (customer_id)
            WHERE order_delivered_customer_date IS NOT NULL GROUP BY 1""",
        """SELECT state, avg(durasi_pengiriman) AS avg_delivery_days
           FROM fakta_pengiriman JOIN dim_pelanggan USING (pelanggan_key) GROUP BY 1""",
    ),
    "q17": (["kategori"], ["avg_delivery_days"], *_DELIVERY_CATEGORY),
    "q18": (
        ["tahun"],
        ["rata_rata_rating"],
        f"""SELECT CAST(year(review_creation_date) AS INTEGER) AS tahun,
                   {_mean2('sum(review_score)', 'count(review_score)')} AS rata_rata_rating
            FROM n_order_reviews GROUP BY 1""",
        f"""SELECT tahun, {_mean2('sum(skor_review)', 'count(skor_review)')} AS rata_rata_rating
            FROM fakta_review JOIN dim_waktu USING (waktu_id) GROUP BY 1""",
    ),
}


def _key_text(pair: str, keys: list[str]) -> str:
    """The JSON text a row is identified by; numbers bare, NULL spelled out."""
    parts = [f"""'{{"pair":"{pair}"'"""]
    for key in keys:
        bare = key in ("tahun", "bulan")
        shown = f"CAST({key} AS VARCHAR)" if bare else f"""'"' || {key} || '"'"""
        parts.append(f"""',"{key}":' || coalesce({shown}, 'null')""")
    return " || ".join([*parts, "'}'"])


def _tall(pair: str, side: str) -> str:
    keys, measures, *_ = _PAIRS[pair]
    return " UNION ALL ".join(
        f"""SELECT {_key_text(pair, keys)} AS key, '{m}' AS measure, CAST({m} AS DOUBLE) AS value
            FROM {side}"""
        for m in measures
    )


def _cells(pair: str) -> tuple[str, dict[str, str]]:
    _, _, normalized, star = _PAIRS[pair]
    # Reconciliation counts every sold item as one.
    star = star.replace("sum(jumlah)", "count(*)")
    steps = {f"{pair}_n": normalized, f"{pair}_s": star}
    sql = f"""
        SELECT '{pair}' AS pair, key, measure, a.key IS NOT NULL AS in_normalized,
               b.key IS NOT NULL AS in_star, a.value AS normalized, b.value AS star,
               abs(a.value - b.value) AS delta,
               a.key IS NOT NULL AND b.key IS NOT NULL
                 AND a.value IS NOT DISTINCT FROM b.value AS match
        FROM ({_tall(pair, f'{pair}_n')}) a
        FULL JOIN ({_tall(pair, f'{pair}_s')}) b USING (key, measure)"""
    return sql, steps


def _summary(pair: str, cells: str) -> str:
    first = _PAIRS[pair][1][0]
    return f"""
        SELECT '{pair}' AS pair, rows_normalized, rows_star,
               CASE WHEN rows_normalized = 1 THEN vn END AS value_normalized,
               CASE WHEN rows_star = 1 THEN vs END AS value_star,
               matching, differing, max_delta, differing = 0 AS match
        FROM (SELECT count(*) FILTER (in_normalized AND measure = '{first}') AS rows_normalized,
                     count(*) FILTER (in_star AND measure = '{first}') AS rows_star,
                     max(normalized) FILTER (measure = '{first}') AS vn,
                     max(star) FILTER (measure = '{first}') AS vs,
                     count(*) FILTER (match) AS matching,
                     count(*) FILTER (NOT match) AS differing,
                     coalesce(max(delta), 0) AS max_delta
              FROM ({cells}))"""


def _pairs() -> dict[str, str]:
    sql = {}
    all_steps: dict[str, str] = {}
    summaries = []
    for pair, (_, _, normalized, star) in _PAIRS.items():
        sql[f"{pair}_n"] = with_tables(normalized)
        sql[f"{pair}_s"] = with_tables(star)
        cells, steps = _cells(pair)
        sql[f"reconcile_{pair}"] = with_tables(cells, **steps)
        all_steps |= steps
        summaries.append(_summary(pair, cells))
    sql["reconcile_all"] = with_tables(" UNION ALL ".join(summaries), **all_steps)
    return sql


# Ways to tables and periods: the questions are known, the way there is new.

_SAME_ROWS = {
    "loaded_top_sellers_ym": "top_sellers_qty_ym",
    "loaded_q14_n": "q14_n",
    "loaded_q16_n": "q16_n",
    "catalog_segment_sellers_y": "segment_sellers_y",
    "catalog_state_distribution_seller": "state_distribution_seller",
    "text_period_items_sold": "kpi_items_sold_ym",
    "blank_period_items_sold": "kpi_items_sold_all",
    **{f"flat_payment_methods_{p}": f"payment_methods_{p}" for p in PERIODS},
    **{f"loaded_sales_series_{p}": f"sales_series_{p}" for p in PERIODS},
}

_BOUGHT = {
    "all": "",
    "y": "WHERE year(order_purchase_timestamp) = 1997",
    "m": "WHERE month(order_purchase_timestamp) = 3",
    "ym": """WHERE order_purchase_timestamp >= TIMESTAMP '1997-03-01'
             AND order_purchase_timestamp < TIMESTAMP '1997-04-01'""",
}


def _sources(known: dict[str, str]) -> dict[str, str]:
    sql = {name: known[same] for name, same in _SAME_ROWS.items()}
    for period, where in _BOUGHT.items():
        sql[f"norm_revenue_{period}"] = with_tables(
            f"""SELECT CAST(year(order_purchase_timestamp) AS INTEGER) AS tahun,
                       CAST(month(order_purchase_timestamp) AS INTEGER) AS bulan,
                       CAST(sum(price) AS DOUBLE) AS total_revenue
                FROM n_order_items JOIN n_orders USING (order_id) {where} GROUP BY 1, 2"""
        )
    return sql


def _positions(totals: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY total_revenue DESC NULLS FIRST, label) AS pos,
                      label, total_qty,
                      CAST(coalesce(total_revenue, 0) AS DOUBLE) AS total_revenue
               FROM ({totals})"""


def _of_any_size() -> dict[str, str]:
    sellers = _positions(_sellers("all"))
    comma = "CASE WHEN pos > 1 THEN ',' ELSE '' END"
    last = 2**63 - 1
    points = [
        ("day", "tahun, bulan, tanggal"), ("month", "tahun, bulan, NULL"),
        ("year", "tahun, NULL, NULL"), ("known", "NULL, NULL, NULL"),
    ]
    sums = "CAST(sum(total_harga) AS DOUBLE) AS revenue, CAST(sum(jumlah) AS BIGINT) AS qty"

    def grain(name: str, names: str, source: str) -> str:
        tahun, bulan, tanggal = names.split(", ")
        keys = [c for c in (tahun, bulan, tanggal) if c != "NULL"]
        group = f"GROUP BY {', '.join(keys)}" if keys else ""
        return f"""SELECT '{name}' AS grain, CAST({tahun} AS INTEGER) AS tahun,
                          CAST({bulan} AS INTEGER) AS bulan, CAST({tanggal} AS DATE) AS tanggal,
                          {sums} FROM {source} {group}"""

    dated = "fakta_penjualan JOIN dim_waktu USING (waktu_id)"
    rollup = [grain(name, names, dated) for name, names in points]
    rollup.append(grain("every", "NULL, NULL, NULL", "fakta_penjualan"))
    sql = {
        "customer_positions": _positions(_customers("all")),
        "seller_positions": sellers,
        "json_fragments_sellers": f"""
            SELECT 0 AS part, pos AS place, {comma} || '"' || label || '"' AS fragment FROM ({sellers})
            UNION ALL SELECT 1, pos, {comma} || total_qty FROM ({sellers})
            UNION ALL VALUES (0, CAST(0 AS BIGINT), '{{"label":['), (0, {last}, ']'),
                             (1, 0, ',"total_qty":['), (1, {last}, ']}}')""",
        "mart_sales_rollup": " UNION ALL ".join(rollup),
    }
    for p in PERIODS:
        sql[f"active_customers_{p}"] = (
            "SELECT count(DISTINCT pelanggan_key) AS active_customers "
            + _facts("fakta_penjualan", p)
        )
    return {name: with_tables(text) for name, text in sql.items()}


def oracle_queries() -> dict[str, str]:
    known = {
        **_model_tables(),
        **_figures(),
        **_distributions(),
        **_boards(),
        **_insights(),
        **_pairs(),
    }
    return known | _sources(known) | _of_any_size()

"""The text columns of insights in SQL, worked out apart from the library."""

from __future__ import annotations

_PERIODS = {"all": "all dates", "y": "1997", "m": "month 03", "ym": "1997-03"}

_EXTREME_DAYS = [("max_label", ""), ("max_days", "2"), ("min_label", ""), ("min_days", "2")]
_EXTREME_RATINGS = [
    ("best_label", ""), ("best_rating", "2"), ("worst_label", ""), ("worst_rating", "2"),
]
_LEAD = [("top_label", ""), ("top_qty", "0"), ("top_share", "1"), ("second_label", ""), ("gap", "1")]

# Kind: subject, figures with their style, signals, action column, what it is about.
_PARTS = {
    "revenue": (
        "revenue",
        [("last_label", ""), ("last_revenue", "m"), ("max_label", ""), ("max_revenue", "m"),
         ("min_label", ""), ("min_revenue", "m")],
        ["trend", "outlook"], "status", "min_label",
    ),
    "payment": (
        "payment methods",
        [("top_method", ""), ("top_count", "0"), ("top_share", "1"), ("second_method", "")],
        ["status"], "status", "top_method",
    ),
    "top_items_product": ("products", _LEAD, ["race"], "status", "top_label"),
    "top_items_category": ("categories", _LEAD, ["race"], "status", "top_label"),
    "state": ("states", [("top_label", ""), ("top_value", "0"), ("gap", "1")], ["race"],
              "action", "top_label"),
    "customer": ("customers", [("top_label", ""), ("top_value", "m"), ("gap", "1")], ["race"],
                 "action", "top_label"),
    "seller_qty": ("sellers by quantity", [("top_label", ""), ("top_value", "0"), ("gap", "1")],
                   ["race"], "action", "top_label"),
    "seller_revenue": ("sellers by revenue", [("top_label", ""), ("top_value", "m"), ("gap", "1")],
                       ["race"], "action", "top_label"),
    "delivery_state": ("delivery by state", _EXTREME_DAYS, ["status"], "action", "max_label"),
    "delivery_category": (
        "delivery by category", _EXTREME_DAYS, ["status"], "action", "max_label"),
    "rating_year": ("rating by year", [("mean_rating", "2"), *_EXTREME_RATINGS], ["status"],
                    "action", "worst_label"),
    "rating_month": ("rating by month", _EXTREME_RATINGS, ["status"], "action", "worst_label"),
}


def _whole(value: str) -> str:
    return f"replace(format('{{:,}}', CAST({value} AS BIGINT)), ',', '.')"


def _comma(value: str, places: int) -> str:
    unit = 10**places
    scaled = f"CAST(round({value} * {unit}) AS BIGINT)"
    cents = f"lpad(CAST({scaled} % {unit} AS VARCHAR), {places}, '0')"
    return f"{_whole(f'{scaled} // {unit}')} || ',' || {cents}"


def _figure(name: str, style: str) -> str:
    shown = {"": f"CAST({name} AS VARCHAR)", "0": _whole(name), "m": f"'R$ ' || {_comma(name, 2)}"}
    text = shown[style] if style in shown else _comma(name, int(style))
    return f"'{name.replace('_', ' ')} ' || {text}"


def with_text(sql: str, kind: str, period: str = "all", by: str = "") -> str:
    """Wrap the SQL of an insight so that it also returns its texts."""
    subject, figures, signals, action, about = _PARTS[f"{kind}_{by}" if by else kind]
    head = f"'{subject}, {_PERIODS[period]}: '"
    now = ", ".join(["status", *(_figure(*figure) for figure in figures)])
    after = ", ".join(f"'{signal} ' || {signal}" for signal in signals)
    return f"""SELECT *, {head} || concat_ws('; ', {now}) AS now_text,
        CASE WHEN status = 'none' THEN '' ELSE {head} || concat_ws('; ', {after}) END AS next_text,
        CASE WHEN status = 'none' THEN ''
             ELSE concat_ws(': ', {action}, CAST({about} AS VARCHAR)) END AS action_text
        FROM ({sql})"""

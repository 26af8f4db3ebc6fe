"""Named collections of tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

Loader = Callable[[], DataFrame]


class _Tables:
    """Tables by attribute name, each resolved once, on first use."""

    #: Tables that are worked out from others of the collection.
    derived: dict[str, tuple[str, ...]] = {}

    def __init__(self, loaders: Mapping[str, Loader | DataFrame]):
        self._loaders = dict(loaders)
        self._resolved: dict[str, DataFrame] = {}

    def names(self) -> list[str]:
        return sorted(self._loaders)

    def has(self, name: str) -> bool:
        return name in self._loaders

    def table(self, name: str) -> DataFrame:
        if name not in self._resolved:
            if name not in self._loaders:
                raise KeyError(f"no table {name!r}; have {self.names()}")
            source = self._loaders[name]
            self._resolved[name] = source if isinstance(source, DataFrame) else source()
        return self._resolved[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self.table(name)
        except KeyError as missing:
            raise AttributeError(str(missing)) from None

    def replace(self, **tables: Loader | DataFrame):
        """A copy in which the given tables take the place of the old ones.

        What was derived from a replaced table is not taken over.
        """
        kept = {**self._loaders, **self._resolved}
        stale = [name for name, of in self.derived.items() if set(of) & set(tables)]
        return type(self)({n: t for n, t in kept.items() if n not in stale} | tables)


class Normalized(_Tables):
    """Orders, items, products, customers and their companions."""


class Mart(_Tables):
    """Four facts, five dimensions, and what is stored of their sums.

    ``restage`` makes the same mart with its shared intermediate tables put
    through a function: (name, table) to the table that the facts derive from.
    """

    derived = {
        "sales_rollup": ("fakta_penjualan", "dim_waktu"),
        "customer_activity": ("fakta_penjualan", "dim_waktu"),
    }

    def __init__(
        self,
        loaders: Mapping[str, Loader | DataFrame],
        restage: Callable[[Callable[[str, DataFrame], DataFrame]], Mart] | None = None,
    ):
        super().__init__(loaders)
        self._restage = restage

    def staged(self, store: Callable[[str, DataFrame], DataFrame]) -> Mart:
        return self._restage(store) if self._restage else self

"""A registry of outside models: named loaders, used inside vectorised functions, loaded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The name that stands for no provider: values pass through.
OFF = "off"


class Registry:
    """Named providers of one kind. A loader makes a function from a series to a series of as many values."""

    def __init__(self) -> None:
        self._loaders: dict[str, Callable[[], Callable[[pd.Series], pd.Series]]] = {}
        self._aliases: dict[str, str] = {}
        self._loaded: dict[str, Callable[[pd.Series], pd.Series]] = {}
        self.errors: dict[str, str] = {}

    @staticmethod
    def key(name: str | None) -> str:
        return (name or OFF).strip().lower().replace("_", "-")

    def register(self, name: str, loader: Callable, aliases: tuple[str, ...] = (), replace: bool = False) -> None:
        key = self.key(name)
        if key == OFF:
            raise ValueError(f"{OFF!r} is reserved")
        if key in self._loaders and not replace:
            raise ValueError(f"{name!r} is registered already")
        self._loaders[key] = loader
        self._loaded.pop(key, None)
        self.errors.pop(key, None)
        self._aliases |= {self.key(a): key for a in aliases}

    def names(self) -> list[str]:
        return sorted(self._loaders)

    def resolve(self, name: str | None) -> str:
        key = self.key(name)
        key = self._aliases.get(key, key)
        if key != OFF and key not in self._loaders:
            raise KeyError(f"no provider {name!r}; there are {', '.join(self.names()) or 'none'}")
        return key

    def get(self, name: str | None) -> Callable[[pd.Series], pd.Series] | None:
        """The provider, loaded at its first use; None for off or where loading failed, which is tried once."""
        key = self.resolve(name)
        if key == OFF or key in self.errors:
            return None
        if key not in self._loaded:
            try:
                self._loaded[key] = self._loaders[key]()
            except Exception as e:  # one provider's failure must not stop the others
                self.errors[key] = f"{type(e).__name__}: {e}"
                return None
        return self._loaded[key]

    def apply(self, name: str | None, column: Column, returns: str) -> Column:
        """The provider's values for a column; the column itself where there is no provider or it fails on a batch. What
        failed is not told here: see `told`."""
        return column if self.resolve(name) == OFF else self.told([name], column, returns)["value"]

    def told(self, names: list[str], column: Column, returns: str) -> Column:
        """A struct of value and error: the values of the first of the providers that loads and does not fail on the batch.

        error says which ones failed, and how; where all did, value is the column itself. None failing, error is null.
        """
        registry, keys = self, [self.resolve(n) for n in names]

        @F.pandas_udf(f"value {returns}, error string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for values in batches:
                out, wrong = values, []
                for key in keys:
                    use = registry.get(key)
                    try:
                        if use is None:
                            raise RuntimeError(registry.errors.get(key, "off"))
                        out = use(values)
                        break
                    except Exception as e:  # the next provider is tried, and the failure is told
                        wrong.append(f"{key}: {type(e).__name__}: {e}")
                yield pd.DataFrame({"value": list(out), "error": [" | ".join(wrong) or None] * len(values)})

        return run(column)

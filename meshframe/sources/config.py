"""Settings in a YAML file, read as attributes; what is not set is None."""

from __future__ import annotations

from pathlib import Path


class Config:
    """Settings of a file, created when it is first saved."""

    def __init__(self, path: str | Path):
        self.__dict__["_path"], self.__dict__["_values"] = Path(path), {}
        if self._path.exists():
            self.load()

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return self._values.get(name)

    def __setattr__(self, name: str, value) -> None:
        self._values[name] = value

    def load(self) -> Config:
        import yaml

        self.__dict__["_values"] = yaml.safe_load(self._path.read_text()) or {}
        return self

    def update(self, **values) -> Config:
        self._values.update(values)
        return self

    def save(self) -> Config:
        import yaml

        self._path.write_text(yaml.safe_dump(self._values))
        return self

"""The registry of tenants: a JSON file, validated as a whole, and its differences."""

from __future__ import annotations

import json
import os
import re
import secrets
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "userId string, apiKey string, vaultPath string, openaiKey string, obsidian struct<email:string,password:string,vault:string,token:string>"
# Formats of a record's fields.
ID_PATTERN, KEY_PATTERN, EMAIL_PATTERN = r"^[a-z0-9-]+$", r"^cv-", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
#: Fixed value: seconds a changed file must rest before it is read.
QUIET = 0.5
#: Fields that never leave the registry.
SECRETS = ["apiKey", "openaiKey", "obsidian"]


class InvalidRegistry(ValueError):
    pass


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Records as they are; malformed JSON fails."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def violations(records: DataFrame) -> DataFrame:
    """(userId, problem) of records that break a rule, and of ids and keys that occur twice."""
    rules = [
        ("userId", F.coalesce(F.col("userId").rlike(ID_PATTERN), F.lit(False))),
        ("apiKey", F.coalesce(F.col("apiKey").rlike(KEY_PATTERN), F.lit(False))),
        ("vaultPath", F.coalesce(F.length("vaultPath") > 0, F.lit(False))),
        ("openaiKey", F.coalesce(F.length("openaiKey") > 0, F.lit(False))),
        ("email", F.coalesce(F.col("obsidian.email").rlike(EMAIL_PATTERN), F.lit(False))),
        ("password", F.coalesce(F.length("obsidian.password") > 0, F.lit(False))),
        ("vault", F.coalesce(F.length("obsidian.vault") > 0, F.lit(False))),
    ]
    broken = records.select("userId", F.explode(F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules]))).alias("problem"))
    twice = records.groupBy("userId").count().filter("count > 1").select("userId", F.lit("duplicate userId").alias("problem"))
    keys = records.groupBy("apiKey").agg(F.count("*").alias("n"), F.max("userId").alias("userId")).filter("n > 1").select("userId", F.lit("duplicate apiKey").alias("problem"))
    return broken.unionByName(twice).unionByName(keys)


def public(records: DataFrame) -> DataFrame:
    """Tenants without secrets."""
    return records.select("userId", "vaultPath", F.lit("unknown").alias("status"))


def by_key(records: DataFrame, api_key: str) -> DataFrame:
    return records.filter(F.col("apiKey") == api_key).drop(*SECRETS)


def by_id(records: DataFrame, user_id: str) -> DataFrame:
    return records.filter(F.col("userId") == user_id).drop(*SECRETS)


def diff(old: DataFrame, new: DataFrame, key: str = "userId") -> DataFrame:
    """(key, change): added, removed or updated records; any field may differ. Keys are unique on both sides."""
    a = old.select(key, F.to_json(F.struct(*[c for c in old.columns if c != key])).alias("__a"), F.lit(True).alias("__old"))
    b = new.select(key, F.to_json(F.struct(*[c for c in new.columns if c != key])).alias("__b"), F.lit(True).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__a") != F.col("__b"), "updated")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change IS NOT NULL")


class Registry:
    """The file itself, on the driver: one small record per tenant."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.users: list[dict] = []
        self._seen: str | None = None

    def load(self) -> list[dict]:
        """Read and validate; a missing file is made, empty."""
        if not self.path.exists():
            self._write([])
        raw = self.path.read_text("utf-8")
        self.users, self._seen = self._valid(raw), raw
        return [dict(u) for u in self.users]

    def reload(self) -> dict[str, list[str]] | None:
        """Changes since the last good content; None if the file is the same or invalid, in which case the last stays."""
        raw = self.path.read_text("utf-8") if self.path.exists() else "[]"
        if raw == self._seen:
            return None
        try:
            users = self._valid(raw)
        except InvalidRegistry:
            return None
        old, new = {u["userId"]: u for u in self.users}, {u["userId"]: u for u in users}
        self.users, self._seen = users, raw
        return {"added": sorted(new.keys() - old.keys()), "removed": sorted(old.keys() - new.keys()), "updated": sorted(k for k in old.keys() & new.keys() if old[k] != new[k])}

    def get(self, user_id: str) -> dict | None:
        """A copy of the tenant's record."""
        return next((dict(u) for u in self.users if u["userId"] == user_id), None)

    def watch(self, quiet: float = QUIET, clock=time.monotonic) -> Callable[[], dict[str, list[str]] | None]:
        """A function to call on every tick of a poll: it reloads once the file has rested for ``quiet`` seconds after a change, so a
        file that is being written in steps is read once."""
        seen, since = self._stamp(), None

        def tick() -> dict[str, list[str]] | None:
            nonlocal seen, since
            now = self._stamp()
            if now != seen:
                seen, since = now, clock()
            if since is None or clock() - since < quiet:
                return None
            since = None
            return self.reload()

        return tick

    def _stamp(self) -> tuple[int, int] | None:
        return (s.st_mtime_ns, s.st_size) if self.path.exists() and (s := self.path.stat()) else None

    @staticmethod
    def _valid(raw: str) -> list[dict]:
        try:
            users = json.loads(raw)
        except ValueError as e:
            raise InvalidRegistry(str(e)) from e
        if not isinstance(users, list):
            raise InvalidRegistry("not a list")
        for u in users:
            inner = u.get("obsidian") if isinstance(u, dict) else None
            texts = [u.get("vaultPath"), u.get("openaiKey"), inner.get("password"), inner.get("vault")] if isinstance(inner, dict) else [None]
            if not all(isinstance(t, str) and t for t in texts) or not (
                isinstance(u.get("userId"), str) and re.search(ID_PATTERN, u["userId"]) and isinstance(u.get("apiKey"), str) and re.search(KEY_PATTERN, u["apiKey"]) and re.search(EMAIL_PATTERN, str(inner.get("email")))
            ):
                raise InvalidRegistry("bad record")
        for field in ("userId", "apiKey"):
            if len({u[field] for u in users}) < len(users):
                raise InvalidRegistry(f"duplicate {field}")
        return users

    def add(self, user: dict) -> dict:
        user = {"apiKey": f"cv-{secrets.token_hex(24)}", **user}
        self._store([*self.users, user])
        return dict(user)

    def remove(self, user_id: str) -> None:
        if all(u["userId"] != user_id for u in self.users):
            raise KeyError(user_id)
        self._store([u for u in self.users if u["userId"] != user_id])

    def _store(self, users: list[dict]) -> None:
        raw = json.dumps(users, indent=2)
        self.users = self._valid(raw)
        self._write(users)
        self._seen = raw + "\n"

    def _write(self, users: list[dict]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        handle, draft = tempfile.mkstemp(dir=self.path.parent, prefix=".registry-")
        with os.fdopen(handle, "w") as f:
            f.write(json.dumps(users, indent=2) + "\n")
        os.replace(draft, self.path)

"""Results kept under names, getters over them, and read-only JSON endpoints."""

from __future__ import annotations

import json
from functools import reduce
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Results:
    """Tables of a folder, a name each; a later result of a name replaces the earlier one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.names = spark, folder, []

    def save(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        if name not in self.names:
            self.names.append(name)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def get(self, name: str, *, where: dict | None = None, least: dict | None = None, top: tuple[int, str] | None = None, key: str | None = None) -> DataFrame:
        """Rows equal to where and not below least; the first of them by a column, largest first, ties by key."""
        df = self.read(name)
        for c, v in (where or {}).items():
            df = df.where(F.col(c).isNull() if v is None else F.col(c) == v)
        for c, v in (least or {}).items():
            df = df.where(F.col(c) >= v)
        if top:
            df = df.orderBy(F.desc(top[1]), *([key] if key else [])).limit(top[0])
        return df

    def search(self, value: int, keys: dict[str, str]) -> DataFrame:
        """result, key, column: integers equal to value in the results named by keys (name: key column)."""
        parts = []
        for name, key in keys.items():
            df = self.read(name)
            whole = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")]
            hits = F.explode(F.filter(F.array(*(F.when(F.col(c) == value, c) for c in whole)), lambda c: c.isNotNull()))
            parts.append(df.select(F.lit(name).alias("result"), F.col(key).cast("string").alias("key"), hits.alias("column")))
        return reduce(DataFrame.unionByName, parts)

    def counts(self) -> dict[str, int]:
        return {n: self.read(n).count() for n in self.names}


def serve(results: Results, host: str = "127.0.0.1", port: int = 0, page: int = 1000) -> ThreadingHTTPServer:
    """A server, not yet started, of GET /api/stats (rows by result) and GET /api/<result>?column=value&limit=n.

    Answers are JSON, at most a page of rows in no stated order; a request reads and never writes. An unknown name or column is 404 or 400.
    """

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            name = url.path.removeprefix("/api/")
            if not url.path.startswith("/api/") or (name != "stats" and name not in results.names):
                return self.answer(404, {"error": f"unknown {url.path}"})
            if name == "stats":
                return self.answer(200, results.counts())
            args = {k: v[0] for k, v in parse_qs(url.query).items()}
            limit = args.pop("limit", str(page))
            df = results.read(name)
            if not limit.isdecimal() or set(args) - set(df.columns):
                return self.answer(400, {"error": f"unknown arguments in {url.query}"})
            for c, v in args.items():
                df = df.where(F.col(c).cast("string") == v)
            self.answer(200, [json.loads(r.value) for r in df.limit(min(int(limit), page)).select(F.to_json(F.struct("*")).alias("value")).collect()])

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

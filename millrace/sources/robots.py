"""robots.txt rules, joined by domain. No rules: allowed; no domain: refused."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace.functions import urls


def allowed(requests: DataFrame, rules: DataFrame, agent: str = "millrace") -> DataFrame:
    """requests (url) with allowed; rules: (domain, body)."""

    @F.pandas_udf("boolean")
    def run(url: pd.Series, body: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}
        out = []
        for u, b in zip(url, body, strict=True):
            if not b:
                out.append(True)
                continue
            if b not in parsers:
                parsers[b] = RobotFileParser()
                parsers[b].parse(b.splitlines())
            out.append(parsers[b].can_fetch(agent, u))
        return pd.Series(out, dtype=bool)

    rows = requests.withColumn("__domain", urls.search_domain(F.col("url")))
    rows = rows.join(rules.select(F.col("domain").alias("__domain"), F.col("body").alias("__body")), "__domain", "left")
    return rows.withColumn("allowed", (F.col("__domain") != "") & run("url", "__body")).drop("__domain", "__body")

"""Several file destinations that change together.

Each destination is a folder of versions.  A load writes one version into each,
where no reader looks yet, then puts one commit file that names them all.
Readers follow the commits, so they see a load in every destination or in none;
a load that broke off leaves versions that no commit names, which
:func:`recover` removes.  Commits are numbered and put only if their number is
free: of two loads at once, the second takes the next number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.ledger import _file_system, _numbered, put_if_absent

COMMITS = "_commits"


def _commits(spark: SparkSession, root: str) -> list[tuple[int, dict]]:
    return _numbered(spark, f"{root}/{COMMITS}", "commit")


def prepare(df: DataFrame, root: str, name: str, load_id: str) -> dict:
    """Writes a version of destination ``name``; no reader sees it before it is committed."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{root}/{name}/v-{load_id}")
    return {"name": name, "version": f"v-{load_id}", "rows": int(seen.get["rows"])}


def commit(spark: SparkSession, root: str, parts: list[dict], load_id: str, replace: bool = False) -> int:
    """Makes all prepared versions visible at once; the commit's number.  A load is committed once."""
    text = json.dumps({"load": load_id, "replace": replace, "parts": parts})
    while True:
        found = _commits(spark, root)
        for number, entry in found:
            if entry["load"] == load_id:
                return number
        number = found[-1][0] + 1 if found else 0
        if put_if_absent(spark, f"{root}/{COMMITS}/commit-{number}", text):
            return number


def fan_out(spark: SparkSession, frames: dict[str, DataFrame], root: str, load_id: str | None = None, replace: bool = False) -> dict:
    """Writes each frame to the destination of its name, all or none; the number of rows of each.

    Run again under the same ``load_id`` after a failure, it prepares every
    destination anew and commits once.
    """
    load_id = load_id or uuid.uuid4().hex
    parts = [prepare(df, root, name, load_id) for name, df in frames.items()]
    commit(spark, root, parts, load_id, replace)
    return {p["name"]: p["rows"] for p in parts}


def read_committed(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The rows of a destination: its versions since the last load that replaced it; None before the first commit."""
    versions: list[str] = []
    for _, entry in _commits(spark, root):
        mine = [p["version"] for p in entry["parts"] if p["name"] == name]
        versions = mine if mine and entry["replace"] else versions + mine
    return spark.read.parquet(*[f"{root}/{name}/{v}" for v in versions]) if versions else None


def recover(spark: SparkSession, root: str) -> list[str]:
    """Removes versions that no commit names, and returns them.  Not to be run while a load is on its way."""
    make, fs = _file_system(spark, root)
    named = {f"{p['name']}/{p['version']}" for _, entry in _commits(spark, root) for p in entry["parts"]}
    gone = []
    for status in fs.globStatus(make(f"{root}/*/v-*")) or []:
        path = status.getPath()
        name = f"{path.getParent().getName()}/{path.getName()}"
        if name not in named:
            fs.delete(path, True)
            gone.append(name)
    return sorted(gone)

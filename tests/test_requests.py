import os
import tempfile

import pytest

from sluice.plans.jobs import run_job
from sluice.plans.requests import connection_from_request, job_from_request
from sluice.specs import SpecError


def test_connections_become_jdbc_urls():
    pg = connection_from_request({"db_type": "postgresql", "host": "db", "database": "shop", "username": "u"})
    assert pg.url == "jdbc:postgresql://db:5432/shop" and pg.user == "u" and pg.dialect == "postgresql"
    my = connection_from_request({"db_type": "mysql", "host": "h", "port": 3307, "database": "d"})
    assert my.url == "jdbc:mysql://h:3307/d"
    lite = connection_from_request({"db_type": "sqlite", "database": "/data/x.db"})
    assert lite.url == "jdbc:sqlite:/data/x.db"
    with pytest.raises(SpecError):
        connection_from_request({"db_type": "oracle", "database": "x"})


def test_request_shapes():
    req = {
        "db_source": {"connection": {"db_type": "postgresql", "database": "s"}, "table_name": "orders",
                      "columns": ["id"], "chunk_size": 500},
        "column_mappings": [{"column_name": "id", "source_dtype": "int64", "target_dtype": "integer"}],
        "db_destination": {"connection": {"db_type": "mysql", "database": "t"}, "table_name": "o2",
                           "if_exists": "append"},
    }
    spec = job_from_request(req)
    assert spec.db_source.fetch_size == 500 and spec.db_source.columns == ("id",)
    assert spec.db_destination.if_exists == "append"
    with pytest.raises(SpecError):
        job_from_request({"column_mappings": [], "file_destination": {"format": "csv", "output_path": "x"}})


def test_request_runs_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="sluice-test-")
    # the amount with a thousands separator is quoted as a CSV field would be
    with open(os.path.join(d, "up_sales.csv"), "w") as fh:
        fh.write('id,region,amount\n1,north,"$1,000"\n2,south,50\n3,north,25\n')
    req = {
        "file_id": "up_sales.csv",
        "column_mappings": [{"column_name": "amount", "source_dtype": "object", "target_dtype": "float"}],
        "aggregations": {"group_by": ["region"], "aggregations": [{"column": "amount", "function": "sum",
                                                                   "alias": "total"}]},
        "file_destination": {"format": "parquet", "output_path": os.path.join(d, "out")},
    }
    res = run_job(spark, job_from_request(req, upload_dir=d, order_by="id"))
    assert res["success"], res
    got = {r["region"]: r["total"] for r in spark.read.parquet(os.path.join(d, "out")).collect()}
    assert got == {"north": 1025.0, "south": 50.0}

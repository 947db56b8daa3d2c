"""The table connector and the command line over a folder of Parquet tables."""

import datetime as dt

from kinfold.__main__ import main
from kinfold.sources.tables import TableConnector, parquet_reader
from kinfold.store import Store


def tables(spark, folder):
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    day = dt.datetime(2020, 1, 1)
    write("employees", [(1, 1, "ann", "lee", "1970-01-02", "ray", day), (2, 1, "ANN", "Lee", "1970-01-02", None, day), (3, 1, "bob", "ray", None, None, day)], "id long, employeelist_id int, first_name string, last_name string, date_of_birth string, maiden_name string, date_modified timestamp")
    write("employeelists", [(1, 7)], "id int, account_id long")
    write("employee_additional_info", [(1, "dea_number", "D1"), (1, "mmis_number", "")], "employee_id long, name string, value string")
    write("credential_matches", [(1, 1, "R", 20), (2, 3, "R", 85)], "id long, employee_id long, registry string, match_summary_status_code int")
    write("matches", [(9, 2, 5, 1)], "id long, employee_id long, exclusion_record_id long, is_ssn_match int")
    write("exclusion_records", [(5, "EX")], "id long, exclusion_list_prefix string")


def test_commands(spark, tmp_path):
    source, hub = str(tmp_path / "source"), f"file://{tmp_path}/hub"
    tables(spark, source)
    lines = main(["backfill", "--hub", hub, "--source", source, "--built-at", "2024-01-01"], spark)
    assert lines == ["links: 3", "identities: 2", "credentials: 1", "exclusions: 1", "profiles: 2", "aliases: 1"]
    found = main(["search", "--hub", hub, "RAY"], spark)
    assert found[-1] == "page 1 of 1, 2 found" and '"has_active_exclusion":true' in found[0] and "ssn_hash" not in found[0]
    assert main(["rebuild-aliases", "--hub", hub, "--verify"], spark) == ["indexed 1 of 1 identities with an alias surname"]
    assert main(["rebuild-aliases", "--hub", hub, "--from-id", "0", "--to-id", "5"], spark) == ["aliases: 1"]
    assert main(["rebuild-profiles", "--hub", hub], spark) == ["profiles: 2"]
    one = Store(spark, hub).read("profiles").first()["identity_id"]
    assert main(["rebuild-profiles", "--hub", hub, "--identity", str(one)], spark) == ["profiles: 2"]
    assert main(["sync", "--hub", hub, "--source", source], spark)[0] == "links: 3"


def test_connector_pushes_ranges_down(spark, tmp_path):
    tables(spark, str(tmp_path))
    connector = TableConnector(parquet_reader(spark, str(tmp_path)), "x", excluded_codes=(85,))
    assert [r["stg_person_id"] for r in connector.people(2, 2).collect()] == [2]
    assert connector.people(since="2020-01-01").count() == 0 and connector.credentials().count() == 1
    plan = connector.people(2, 3)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,2)" in plan and "LessThanOrEqual(id,3)" in plan

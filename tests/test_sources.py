"""File layouts: column order, NA, globs, consolidation, the sinks."""

from __future__ import annotations

import datetime as dt
import gzip
from concurrent.futures import ThreadPoolExecutor

import pytest
from compare import records_read

from edaflux.sources import challenge, commits, ensemble, observations, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture()
def targets(tmp_path):
    head = "site_id,startDateTime,flux,flux_err\n"
    put(tmp_path / "t/targets-2016-12.csv", head + "AAAA,2016-12-31T00:00:00Z,9.0,0.9\n")
    put(tmp_path / "t/targets-2017-01.csv", head + "AAAA,2017-01-01T00:00:00Z,1.5,0.1\nBBBB,2017-01-02T00:00:00Z,NA,NA\n")
    put(tmp_path / "t/targets-2017-02.csv", head + "AAAA,2017-02-01T00:00:00Z,NaN,0.2\n")
    return str(tmp_path / "t")


def test_year_month_and_list(spark, targets):
    year = observations.download_values(spark, targets, "targets", 2017)
    assert year.columns == ["site_id", "datetime", "flux", "flux_err"]
    assert year.count() == 3
    month = observations.download_values(spark, targets, "targets", "2017", 1).collect()
    assert sorted((r.site_id, r.flux) for r in month) == [("AAAA", 1.5), ("BBBB", None)]
    assert month[0].datetime.tzinfo is None and month[0].datetime in (dt.datetime(2017, 1, 1), dt.datetime(2017, 1, 2))
    assert observations.targets_available(spark, targets).count() == 4
    assert observations.targets_available(spark, targets, ["2016-12", "2017-02"]).count() == 2
    assert observations.download_values(spark, targets, "targets", 2030).count() == 0


def test_nan_becomes_null(spark, targets):
    assert observations.download_values(spark, targets, "targets", 2017, 2).first().flux is None


def test_sensor_layouts_bind_by_name(spark, tmp_path):
    put(tmp_path / "d/soil_drivers-ABBY-2025-04.csv", "startDateTime,SOILT,VSWC\n2025-04-01T00:00:00Z,6.1,0.10\n")
    put(tmp_path / "d/site-x/soil_drivers-BARR-2025-04.csv", "startDateTime,SOILT,VSWC\n2025-04-02T00:00:00Z,-3.0,NA\n")
    put(tmp_path / "d/soil_drivers-BARR-2025-05.csv", "startDateTime,SOILT,VSWC\n2025-05-02T00:00:00Z,9.0,0.3\n")
    put(tmp_path / "m/sensors-2025-03.csv", "site_id,startDateTime,VSWC,SOILT\nABBY,2025-03-31T00:00:00Z,0.2,5.0\n")
    got = observations.consolidate_sensor_month(spark, str(tmp_path / "d"), "2025-04")
    assert sorted(tuple(r)[0::2] for r in got.select("site_id", "startDateTime", "SOILT").collect()) == [("ABBY", 6.1), ("BARR", -3.0)]
    monthly = observations.download_values(spark, str(tmp_path / "m"), "soil-env", 2025)
    assert monthly.columns == ["site_id", "datetime", "SOILW", "TSOIL"] and monthly.first().TSOIL == 5.0
    raw = observations.read_csv(spark, str(tmp_path / "m"), observations.SENSOR_MONTH_CSV)
    both = observations.from_both_sensor_layouts(raw, got)
    assert sorted((r.VSWC is None, r.SOILT) for r in both.collect()) == [(False, 5.0), (False, 6.1), (True, -3.0)]


def test_flux_consolidation_takes_the_site_from_the_body(spark, tmp_path):
    head = "site_id,startDateTime,flux,flux_err\n"
    put(tmp_path / "a/forecast_prediction-ABBY-2025-04.csv", head + "ABBY,2025-04-01T00:00:00Z,1.0,0.1\n")
    put(tmp_path / "b/forecast_prediction-BARR-2025-04.csv", head + "BARR,2025-04-01T00:00:00Z,2.0,0.1\n")
    got = observations.consolidate_flux_month(spark, str(tmp_path), "2025-04")
    assert sorted((r.site_id, r.flux) for r in got.collect()) == [("ABBY", 1.0), ("BARR", 2.0)]


def test_challenge_variables_of_one_dataset_come_once(spark, tmp_path):
    text = (
        "project_id,site_id,datetime,duration,variable,observation\n"
        "p,AAAA,2024-01-01,P1D,nee,1.0\np,AAAA,2024-01-02,P1D,le,2.0\np,BBBB,2024-01-01,P1D,nee,3.0\np,AAAA,2024-02-01,P1D,nee,4.0\n"
    )
    path = tmp_path / "fluxes-targets.csv.gz"
    path.write_bytes(gzip.compress(text.encode()))
    got = challenge.get_forecast_data(
        spark, {"fluxes": str(path)}, "2024-01-01", "2024-01-31", ["nee", "le"], ["AAAA"]
    )
    assert sorted((r.variable, r.observation) for r in got.collect()) == [("le", 2.0), ("nee", 1.0)]


def test_sink_replaces_only_the_days_it_writes(spark, tmp_path):
    cols = "site_id string, model string, day date, mean double, sd double, q0025 double, q0100 double, q0500 double, q0900 double, q0975 double"

    def summary(day, mean):
        return spark.createDataFrame([("s", "lm", dt.date.fromisoformat(day), mean, 1.0, 0.1, 0.2, 0.3, 0.4, None)], cols)

    out = str(tmp_path / "out")
    sinks.write_daily_forecasts(summary("2024-01-01", 1.0), out)
    sinks.write_daily_forecasts(summary("2024-01-02", 2.0), out)
    sinks.write_daily_forecasts(summary("2024-01-02", 3.0), out)
    rows = spark.read.option("header", True).option("nullValue", "NA").csv(out).collect()
    assert sorted(r["mean"] for r in rows) == ["1.0", "3.0"]
    assert rows[0]["q0.975"] is None and "q0.10" in rows[0].asDict()


def test_ensemble_is_pruned_by_reference_date(spark, tmp_path):
    rows = [
        (f"gec{m:02d}", "00", 3600.0 * h, dt.datetime(2024, 1, d, h), "ensemble", s, v, 9999.0 if h == 3 else 280.0 + h, dt.date(2024, 1, d))
        for m in (0, 1) for d in (1, 2) for h in (0, 3) for s in ("AAAA", "BBBB") for v in ("TSOIL", "SOILW", "WIND")
    ]
    out = str(tmp_path / "ens")
    sinks.write_ensemble(spark.createDataFrame(rows, ensemble.ENSEMBLE_LONG), out)
    long = ensemble.read_ensemble(spark, out)
    got = ensemble.gefs_soil_forecasts(long, "2024-01-02", ["AAAA"], ["TSOIL", "SOILW"])
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(reference_datetime" in plan
    assert "In(variable, [SOILW,TSOIL])" in plan and "EqualTo(site_id,AAAA)" in plan
    assert sorted((r.ensemble, r.horizon, r.TSOIL) for r in got.collect()) == [
        ("gec00", 0.0, 280.0), ("gec00", 10800.0, None), ("gec01", 0.0, 280.0), ("gec01", 10800.0, None)
    ]
    meta = spark.createDataFrame(
        [("AAAA", 1.0, 2.0, 1), ("BBBB", 1.0, 2.0, 0)], "field_site_id string, field_latitude double, field_longitude double, terrestrial int")
    assert {r.site_id for r in ensemble.noaa_soil_drivers(long, meta, "2024-01-01").collect()} == {"AAAA"}
    month = ensemble.month_of_drivers(long, "2024-01-01", "2024-01-31")
    assert month.count() == 4 and {r.TSOIL for r in month.collect()} == {280.0}


# Committed output


def month_of(spark, flux, months=(1,), copies=1):
    rows = [("AAAA", dt.datetime(2024, m, d), flux, 0.1) for m in months for d in range(1, 4 * copies)]
    return spark.createDataFrame(rows, "site_id string, startDateTime timestamp, flux double, flux_err double")


def fluxes(spark, out):
    rows = observations.targets_available(spark, out).collect()
    return {(r.datetime.month, r.flux) for r in rows}


def left_over(tmp_path):
    return [f.name for f in (tmp_path / "t").iterdir() if not f.name.endswith((".csv", ".crc"))]


def test_a_rerun_replaces_its_months(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.write_month_of_targets(month_of(spark, 1.0, (1, 2)), out)
    sinks.write_month_of_targets(month_of(spark, 9.0, (1,)), out)
    assert fluxes(spark, out) == {(1, 9.0), (2, 1.0)} and left_over(tmp_path) == []
    sinks.write_month_of_targets(month_of(spark, 7.0, (1,)).limit(0), out)
    assert fluxes(spark, out) == {(1, 9.0), (2, 1.0)} and left_over(tmp_path) == []


def test_a_name_of_several_files_shrinks_to_one(spark, tmp_path, monkeypatch):
    out, name = str(tmp_path / "t"), "targets-2024-01"
    folder = commits.Folder(spark, out)
    put(tmp_path / "t/targets-2024-01.csv", "old\n")
    put(tmp_path / "t/targets-2024-01.2.csv", "old\n")
    put(tmp_path / "t/targets-2024-01.12.csv", "old\n")
    put(tmp_path / "t/targets-2024-02.2.csv", "site_id,startDateTime,flux,flux_err\n")
    sinks.write_month_of_targets(month_of(spark, 3.0), out)
    assert sorted(f.name for f in (tmp_path / "t").glob("*.csv")) == [f"{name}.csv", "targets-2024-02.2.csv"]
    # Two staged files of one name are two files, and both are read.
    aside = commits.Staged(folder)
    for k in (1, 2):
        folder.create(f"{aside.name}/_name={name}/part-{k}.csv", f"site_id,startDateTime,flux,flux_err\nAAAA,2024-01-0{k}T00:00:00Z,{k}.0,NA\n")
    aside.commit()
    assert fluxes(spark, out) == {(1, 1.0), (1, 2.0)} and left_over(tmp_path) == []


@pytest.mark.parametrize("stop", ["write", "record", "lock", "first move", "moves", "staging"])
def test_a_crash_between_the_steps(spark, tmp_path, monkeypatch, stop):
    """A commit that crashes before its manifest leaves no trace; behind it, the next writer carries it out first."""
    out = str(tmp_path / "t")
    sinks.write_month_of_targets(month_of(spark, 1.0, (1, 2, 3)), out)

    class Crash(BaseException):
        pass

    def crash(*_):
        raise Crash

    moved = []

    def one_move(self, source, target, move=commits.Staged._move):
        if moved:
            raise Crash
        moved.append(target)
        move(self, source, target)

    changes = {
        "write": ("Staged.record", crash), "record": ("Staged.lock", crash), "lock": ("Staged.apply", crash),
        "first move": ("Staged._move", one_move), "moves": ("_numbered", crash), "staging": ("Folder.remove", crash),
    }
    with monkeypatch.context() as m:
        m.setattr(f"edaflux.sources.commits.{changes[stop][0]}", changes[stop][1])
        with pytest.raises(Crash):
            sinks.write_month_of_targets(month_of(spark, 2.0, (1, 2)), out)
    begun = stop not in ("write", "record")
    done = {"write": 1.0, "record": 1.0, "lock": 1.0, "moves": 2.0, "staging": 2.0}
    if stop in done:
        assert fluxes(spark, out) == {(1, done[stop]), (2, done[stop]), (3, 1.0)}
    else:
        assert {f for m, f in fluxes(spark, out) if m < 3} == {1.0, 2.0}  # each month whole, of one writer
    sinks.write_month_of_targets(month_of(spark, 5.0, (3,)), out)
    assert fluxes(spark, out) == {(1, 2.0 if begun else 1.0), (2, 2.0 if begun else 1.0), (3, 5.0)}
    assert not begun or left_over(tmp_path) == []


def test_two_writers_take_turns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "WAIT", 0.01)
    out = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: sinks.write_month_of_targets(month_of(spark, float(k), (1, 2)), out), range(4)))
    kept = fluxes(spark, out)
    assert len(kept) == 2 and len({f for _, f in kept}) == 1 and left_over(tmp_path) == []
    assert observations.targets_available(spark, out).count() == 6


def test_a_live_lock_is_waited_for_and_a_dead_one_is_not(spark, tmp_path):
    folder = commits.Folder(spark, str(tmp_path / "t"))
    put(tmp_path / "t/x.txt", "")
    assert folder.create(commits.LOCK, "_staging-gone") and not folder.create(commits.LOCK, "other")
    assert not commits.recover(folder) and commits.recover(folder, lease=-1.0)
    assert not folder.exists(commits.LOCK) and commits.recover(folder)


def test_failed_renames_raise(spark, tmp_path):
    out = str(tmp_path / "t")
    put(tmp_path / "t/targets-2024-01.csv/in-the-way", "")  # a folder of that name cannot be replaced
    with pytest.raises(OSError):
        sinks.write_month_of_targets(month_of(spark, 1.0), out)


def test_only_matching_reference_dates_are_read(spark, tmp_path):
    first = dt.date(2024, 1, 1)
    rows = [
        (f"gec{m:02d}", "00", 3600.0 * h, dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h), "ensemble", "AAAA", "TSOIL", 280.0, first + dt.timedelta(days=d))
        for d in range(100) for m in range(5) for h in range(0, 48, 6)
    ]
    out = str(tmp_path / "ens")
    sinks.write_ensemble(spark.createDataFrame(rows, ensemble.ENSEMBLE_LONG), out)
    long = ensemble.read_ensemble(spark, out)
    origins = lambda *days: spark.createDataFrame([("AAAA", first + dt.timedelta(days=d), "P1D") for d in days], "site_id string, origin date, duration string")
    for days, dates in (((51,), 1), ((11, 91), 2)):  # of two dates far apart, those between are not read either
        before = records_read(spark)
        got = ensemble.previous_run(long, origins(*days), ["TSOIL"]).collect()
        assert {(r.origin - r.reference_datetime).days for r in got} == {1} and len({r.origin for r in got}) == len(days)
        assert 0 < records_read(spark) - before <= dates * 40
    assert ensemble.previous_run(long, origins(), ["TSOIL"]).count() == 0

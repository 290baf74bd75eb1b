"""Adapters on small payloads of each shape, and the load that follows them."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rosterlake.plans import ingest
from rosterlake.sources import adapters, sinks


def payload(spark, *docs, **more):
    rows = [(json.dumps(d) if not isinstance(d, str) else d, *(v[i] for v in more.values())) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, ["payload", *more])


def got(df):
    return sorted(tuple(str(r[c]) for c in ("record", "branch", "day_text", "start_text", "end_text", "time_text")) for r in df.collect())


def test_siloam_pools_sessions(spark):
    listing = payload(spark, {"data": [{"doctor_id": "d1", "name": "dr. A, Sp.DV", "specialization_name": "Dermatology"}, {"doctor_id": None, "name": "x"}]}, "{broken")
    plan = payload(spark, {"data": {"availability": [{"hospital_name": "Siloam Kebon Jeruk", "hospital_address": "Jakarta"}, {"hospital_name": "Siloam Surabaya", "hospital_address": ""}], "schedule": [{"doctor_id": "d1", "day": 1, "from_time": "08:00:00", "to_time": "10:00:00"}]}})
    assert got(adapters.siloam(listing, plan)) == [("d1", "Siloam Kebon Jeruk", "1", "08:00:00", "10:00:00", "None"), ("d1", "Siloam Surabaya", "1", "08:00:00", "10:00:00", "None")]


def test_mitra_keluarga(spark):
    rows = [{"ref_id": "r1", "doctor": {"name": "dr. B"}, "clinic": {"name": "MK Bekasi"}, "speciality": {"name": "Kulit dan Kelamin"}, "schedules": [{"day": "Senin", "start_time": "08:00", "end_time": "09:00", "on_leave": False}, {"day": "Senin", "start_time": "1", "end_time": "2", "on_leave": True}]}, {"ref_id": "r2", "clinic": None}]
    assert got(adapters.mitra_keluarga(payload(spark, {"data": rows}))) == [("r1", "MK Bekasi", "Senin", "08:00", "09:00", "None")]


def test_hermina(spark):
    listing = payload(spark, {"data": [{"attributes": {"full_name": "dr. C", "slug": "c", "speciality": "s", "practic_locations": ["Hermina Depok"]}}, {"attributes": {"slug": "far", "practic_locations": ["Hermina Medan"]}}]})
    plan = payload(spark, {"data": {"Hermina Depok": {"Poli": [{"day": "Rabu", "from_time": "08:00", "to_time": "10:00"}]}}}, slug=["c"])
    assert got(adapters.hermina(listing, plan)) == [("c", "Hermina Depok", "Rabu", "08:00", "10:00", "None")]


def test_rs_pondok_indah_and_sentra_medika(spark):
    listing = payload(spark, {"data": [{"fullname_doctor": "dr. D", "doctor_code": "D", "specialty": "x", "doctor_schedule": [{"hospital": "RS Pondok Indah - Pondok Indah", "clinics": [{"clinic_name": "k", "schedules": []}]}]}]})
    assert got(adapters.rs_pondok_indah(listing)) == [("D", "RS Pondok Indah - Pondok Indah", "None", "None", "None", "None")]
    one = {"id": 7, "slug": "e", "full_name": "dr. E", "specializations": [{"name": "Sp.DVE"}], "hospitals": [{"name": "Sentra Medika Cikarang"}]}
    listing = payload(spark, {"data": [one]}, {"data": [{**one, "full_name": "dr. E later"}]}, spec=[60, 66], page=[1, 1])
    plan = payload(spark, {"data": [{"polyclinic_name": "p", "hospitals": [{"hospital_name": "Sentra Medika Cikarang", "schedules": [{"day": "Kamis", "shifts": [{"start_time": "08:00", "end_time": "09:00"}] * 2}]}]}]}, slug=["e"])
    df = adapters.sentra_medika(listing, plan)
    assert got(df) == [("7", "Sentra Medika Cikarang", "Kamis", "08:00", "09:00", "None")] and df.first()["raw_name"] == "dr. E later"


def test_brawijaya_first_record_wins(spark):
    branches = payload(spark, {"data": [{"rsid": 7, "name_hospital": "Brawijaya Depok"}]})
    doc = {"pid": 1, "dokter": "dr. F", "schedules": [{"weekday": 2, "start_hour": "8", "start_minute": 30, "end_hour": "10", "end_minute": None}]}
    plan = payload(spark, {"data": [{"specialist": "Kulit", "doctors": [doc, {**doc, "dokter": "again"}]}, {"specialist": "Jantung", "doctors": [doc]}]}, rsid=[7])
    assert got(adapters.brawijaya(branches, plan)) == [("1", "Brawijaya Depok", "2", "08:30", "10:00", "None")]


RADJAK = """<select name="unit"><option value="all">Semua</option><option value="b">Radjak Hospital Salemba</option><option value="p">Radjak Hospital Purwakarta</option></select>
<div class="col-md-4 mb-4"><img src=x alt="dr. G, Sp.KK"><p>Spesialis Kulit dan Kelamin</p><p>Radjak Hospital Salemba</p>
<div class="row"><div class="col-md-4">Senin</div><div class="col-md-8">08.00 - 10.00 dan 13.00-14.00</div></div><div class="row"><div class="col-md-4">Rabu</div><div class="col-md-8">-</div></div>
<div class="row"><div class="col-md-4">Kamis</div><div class="col-md-8">dengan perjanjian</div></div><a href="/dokter/detail/1">Lihat</a></div>
<div class="col-md-4 mb-4"><img alt="dr. H, Sp.PK"><p>Spesialis Kulit dan Kelamin</p>Radjak Hospital Salemba<a href="/dokter/detail/2">x</a></div>
<div class="col-md-4 mb-4"><img alt="dr. I, Sp.DV"><p>Spesialis Kulit dan Kelamin</p>Radjak Hospital Purwakarta<a href="/dokter/detail/3">x</a></div>"""
SARI = """<select form-data="hospital"><option value="">Semua Cabang</option><option value="rs-c">RS Sari Asih Ciputat</option><option value="rs-s">RS Sari Asih Serang</option></select>
<div id="dokter_7"><h4>dr. J, Sp.KK</h4><a class="text-link" href="/d/7">x</a><table class="schedule_doctor"><tbody><tr><td>Senin</td><td>08:00 - 10:00</td></tr><tr><td>Rabu</td><td>-</td></tr></tbody><a data-hospital="rs-c">y</a></table>
<table class="schedule_doctor"><tbody><tr><td>Selasa</td><td>08:00 - 10:00</td></tr></tbody><a data-hospital="rs-s">y</a></table></div>
<div id="dokter_8"><h4>dr. K, Sp.DVE</h4><span class="badge">Ciputat</span></div><div id="dokter_9"><h4>dr. L, Sp.A</h4><span class="badge">Ciputat</span></div>"""
COLUMBIA = """<div class="find-doctor-item"><h4>dr. M</h4><div class="find-doctor-info"><div>RSCA BSD</div><div>Dermatology</div></div><a href="/doctor-appointment/m">Buat janji</a></div>
<div class="find-doctor-item"><h4>dr. N</h4><div class="find-doctor-info"><div>Cardiology</div></div><a href="/doctor-appointment/n">x</a></div>"""
COLUMBIA_DETAIL = '<div class="pt-doctor-info"><strong>Dermatology</strong><strong>BSD</strong></div><table class="table-schedule"><tbody><tr><td>Monday</td><td>08:00 - 10:00<br>13:00 - 14:00</td></tr><tr><td>Friday<td>call us</tr></tbody></table>'
PREMIER = """<div class="doctor-item"><h6>dr. O, Sp.KK</h6><a class="button-outline" href="/o">Profil</a><a class="toggle-shcedule" data-id="11">Lihat jadwal</a></div><div class="doctor-item"><h6>dr. P, Sp.KKLP</h6><a class="toggle-shcedule" data-id="12">x</a></div>"""
PREMIER_DETAIL = '<table class="table-dekstop"><thead><tr><th>Senin</th><th>Selasa</th></tr></thead><tbody><tr><td>08:00 - 09:00 10:00 - 11:00</td><td>-</td></tr></tbody></table>'
MAYAPADA_CARD = '<div class="w"><a href="/find-doctor/detail/q"><p>dr. Q, Sp.KK</p></a><table class="table"><tr><td>Hospital</td><td>Mayapada Hospital Kuningan</td></tr></table></div>'
MAYAPADA = f'<div id="doctor_list"><div class="d-none d-md-block">{MAYAPADA_CARD}</div><div class="d-block d-md-none">{MAYAPADA_CARD}</div>{MAYAPADA_CARD.replace("detail/q", "detail/r").replace("Kuningan", "Surabaya")}</div>'
PRIMAYA = '<div class="item asp_r_pagepost asp_r_pagepost_55"><div class="doctor-card-name"><a href="/s">dr. S, Sp.KK</a></div><div class="doctor-card-location">Karawang</div></div><div class="item asp_r_pagepost asp_r_pagepost_56"><div class="doctor-card-name">dr. T</div><div class="doctor-card-location">Makassar, Jakarta Street</div></div>'
BETHSAIDA = """<div class="doctor-list-schedule"><div class="doctor-profile media"><a href="/dokter/detaildokter/u">Detail Dokter</a><div class="media-content"><b>dr. U, Sp.KK</b></div><span class="media-figure__caption">Bethsaida Hospital Gading Serpong</span></div>
<div class="doctor-schedule"><table class="doctor-schedule-table"><tbody><tr><td data-label="Senin">14:00-16:00</td><td data-label="Selasa">14:00-16:0014:00-17:00</td><td data-label="Rabu"> </td></tr></tbody></table></div></div><div class="doctor-list-schedule"><div class="media-content"><b>Jadwal</b></div></div>"""
EMC = """<div class="doctor-list-schedule"><a href="/doctors/v">Detail Dokter</a><div class="media-content"><b>dr. V</b></div><span class="media-figure__caption">EMC Alam <i>Sutera</i></span>
<a class="anchor-button" href="/doctor-schedule?hospital=as&day=3&start_time=08:00&end_time=09:30">MAKE APPOINTMENT</a><a class="anchor-button" href="/doctor-schedule?hospital=as">x</a></div>"""
EKA = """<div class="doctor-card"><a data-testid="link-profile-doctor" href="/w"><h3 data-testid="doctor-name">dr. W, Sp.KK</h3></a><p data-testid="doctor-location">Eka Hospital Pluit, Eka Hospital Pekanbaru</p><p data-testid="selected-doctor-location">Eka Hospital Pluit</p>
<div class="r"><div><span data-testid="doctor-schedule-day">Senin</span></div><span data-testid="doctor-schedule-times">08:00 - 09:00</span><span data-testid="doctor-schedule-times">13:00 - 14:00</span></div></div>
<div class="doctor-card"><h3 data-testid="doctor-name">dr. X</h3><p data-testid="doctor-location">Eka Hospital Pekanbaru</p></div>"""


def frame(spark, page, **more):
    rows = [("u1", page, *more.values()), ("u2", None, *more.values()), ("u3", "<div class=broken", *more.values())]
    return spark.createDataFrame(rows, ["url", "html", *more])


def payload_pages(spark):
    details = lambda key, page: spark.createDataFrame([(key, page), ("other", None)], "record string, html string")
    return {
        "radjak": (frame(spark, RADJAK),), "sari_asih": (frame(spark, SARI),), "mayapada": (frame(spark, MAYAPADA),), "primaya": (frame(spark, PRIMAYA),), "bethsaida": (frame(spark, BETHSAIDA),),
        "emc": (frame(spark, EMC),), "eka": (frame(spark, EKA),), "columbia_asia": (frame(spark, COLUMBIA, branch="RS Columbia Asia BSD"), details("/doctor-appointment/m", COLUMBIA_DETAIL)),
        "rs_premier": (frame(spark, PREMIER, branch="RS Premier Bintaro"), details("11", PREMIER_DETAIL)),
    }


def test_pages_of_every_shape(spark):
    rows = adapters.all_sources(payload_pages(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["record"], r["raw_name"], r["branch"], r["day_text"], r["time_text"], r["start_text"]))
    key = lambda x: tuple(map(str, x))
    want = {
        "radjak": [("dr. g, sp.kk", "dr. G, Sp.KK", "Radjak Hospital Salemba", d, t, None) for d, t in (("Kamis", "dengan perjanjian"), ("Senin", "08.00 - 10.00 dan 13.00-14.00"))],
        "sari_asih": [("dokter_7@rs-c", "dr. J, Sp.KK", "RS Sari Asih Ciputat", "Senin", "08:00 - 10:00", None), ("dokter_8@rs-c", "dr. K, Sp.DVE", "RS Sari Asih Ciputat", None, None, None)],
        "columbia_asia": [("/doctor-appointment/m", "dr. M", "RS Columbia Asia BSD", d, t, None) for d, t in (("Friday", "call us"), ("Monday", "08:00 - 10:00"), ("Monday", "13:00 - 14:00"))],
        "rs_premier": [("11", "dr. O, Sp.KK", "RS Premier Bintaro", "Senin", t, None) for t in ("08:00 - 09:00", "10:00 - 11:00")],
        "mayapada": [("/find-doctor/detail/q", "dr. Q, Sp.KK", "Mayapada Hospital Kuningan", None, None, None)],
        "primaya": [("55", "dr. S, Sp.KK", "Karawang", None, None, None)],
        "bethsaida": [("dr. u, sp.kk", "dr. U, Sp.KK", "Bethsaida Hospital Gading Serpong", d, t, None) for d, t in (("Selasa", "14:00-16:0014:00-17:00"), ("Senin", "14:00-16:00"))],
        "emc": [("dr. v", "dr. V", "EMC Alam Sutera", "3", None, "08:00")],
        "eka": [("dr. w, sp.kk", "dr. W, Sp.KK", "Eka Hospital Pluit", "Senin", t, None) for t in ("08:00 - 09:00", "13:00 - 14:00")],
    }
    assert {k: sorted(v, key=key) for k, v in by.items()} == {k: sorted(v, key=key) for k, v in want.items()}


def test_load_of_pages(spark):
    raw = adapters.REGISTRY["radjak"](frame(spark, RADJAK))
    facilities = spark.createDataFrame([(5, "RS Radjak Salemba", None), (6, "RS Hermina", None)], "id long, name string, grp string")
    people, times = ingest.load(raw, facilities)
    assert [(r["person"], r["facility"]) for r in people.collect()] == [("g", 5)]
    assert sorted((r["day"], r["start_time"], r["end_time"], r["confidence"]) for r in times.collect() if r["day"] == 0) == [(0, "08:00", "10:00", "high"), (0, "13:00", "14:00", "high")]
    s = ingest.summary(raw, ingest.resolve(raw, facilities.filter("id = 6"))).first()
    assert (s["records"], s["not_specialist"], s["unmatched"], s["unmatched_names"]) == (1, 0, 1, ["Radjak Hospital Salemba"])
    emc = ingest.sessions(adapters.REGISTRY["emc"](frame(spark, EMC))).first()
    assert (emc["day"], emc["start_time"], emc["end_time"], emc["confidence"]) == (2, "08:00", "09:30", "high")


def test_first_seen_branch_wins(spark):
    rows = [("s", "r", "Radjak Salemba", 5, 2), ("s", "r", "Radjak  Salemba.", 5, 1), ("s", "r", "Hermina", 6, 3), ("s", "q", "x", None, 1)]
    df = spark.createDataFrame(rows, "source string, record string, branch string, facility long, position int")
    assert sorted(r["branch"] for r in ingest.first_seen(df).collect()) == ["Hermina", "Radjak  Salemba."]


def test_names_are_normalised_at_the_load(spark):
    raw = spark.createDataFrame([("s", "r", "dr. \uff21ni, Sp.KK", None, "\uff32\uff33 Tebet")], "source string, record string, raw_name string, credentials string, branch string")
    facilities = spark.createDataFrame([(1, "RS Tebet", None)], "id long, name string, grp string")
    r = ingest.resolve(raw, facilities).first()
    assert (r["branch"], r["raw_name"], r["facility"]) == ("RS Tebet", "dr. Ani, Sp.KK", 1)


@pytest.mark.parametrize(
    ("source", "branch", "address", "yes"),
    [
        ("emc", "EMC Alam Sutera", "", True), ("hermina", "Hermina Kemayoran", "", True), ("hermina", "Hermina Medan", "", False), ("eka", "Eka Hospital Pluit", "", True), ("eka", "Eka BSD Pekanbaru", "", False), ("siloam", "Siloam Asri", "", True),
        ("siloam", "Siloam X", "Jl. Y, Jakarta", True), ("siloam", "Siloam Surabaya", "", False), ("rs_pondok_indah", "RS Pondok Indah - Pondok Indah", "", True), ("rs_pondok_indah", "Pondok Indah Klinik", "", False), ("radjak", "Radjak Hospital Purwakarta", "", False),
        ("radjak", "Radjak Hospital Salemba", "", True), ("brawijaya", "anything", "", True), ("primaya", None, "", False), ("bethsaida", "Bethsaida Serang", "", False),
    ],
)
def test_scope(spark, source, branch, address, yes):
    df = spark.createDataFrame([(branch, address)], "b string, a string")
    assert df.select(adapters.near(adapters.SOURCES[source], F.col("b"), F.col("a")).alias("y")).first()["y"] is yes


def test_every_source_is_registered():
    assert set(adapters.REGISTRY) == set(adapters.SOURCES) and len(adapters.SOURCES) == 15


def test_sinks(spark, tmp_path):
    df = spark.range(30).withColumnRenamed("id", "facility")
    for _ in range(2):
        sinks.write_table(df, f"{tmp_path}/t")
        sinks.write_report(df, f"{tmp_path}/r", sample=20)
        sinks.write_csv(df, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 30 and spark.read.json(f"{tmp_path}/r").count() == 20
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 30
    old = spark.createDataFrame([(1, "a", 0.1), (2, "a", 0.2)], "facility long, universe string, score double")
    new = spark.createDataFrame([(1, "a", 0.9)], "facility long, universe string, score double")
    assert sorted((r[0], r[2]) for r in sinks.merge_scores(old, new).collect()) == [(1, 0.9), (2, 0.2)]
    assert sinks.signature(old, ["facility"]).select("signature").distinct().count() == 2

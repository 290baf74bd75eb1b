"""Fifteen sources in one raw-record shape.

Every adapter takes frames of cached payloads (a text column) and returns RAW rows: one per session,
or one without day and time for a record that has none. Region hints, the key that tells repeats
apart, and the highest confidence a source's times can have are data, not code.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.text import collapse, is_specialist
from rosterlake.operators.matching import first_wins, in_region
from rosterlake.sources import cards
from rosterlake.sources.payloads import last_write_wins

RAW = ("source", "record", "raw_name", "credentials", "branch", "day_text", "start_text", "end_text", "time_text", "source_url")


@dataclass(frozen=True)
class Source:
    """What differs between sources beside their payload's shape: hints of the region in branch names, in
    addresses, hints against it, whole names out of scope, the end of a name that is in it."""

    name: str
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    address: tuple[str, ...] = ()
    outside: tuple[str, ...] = ()
    ends: str = ""
    most: str = "high"


#: Region hints of each source; one without hints has branches in the region only.
SOURCES = {
    s.name: s
    for s in (
        Source(
            "siloam", ("kebon jeruk", "asri", "tb simatupang", "mampang", "kelapa dua", "lippo village", "lippo cikarang", "bekasi", "bogor", "sentosa", "cempaka putih", "semanggi", "senayan"),
            address=("jakarta", "bogor", "depok", "tangerang", "bekasi", "banten"),
        ),
        Source("mitra_keluarga", ("bekasi", "bintaro", "cibubur", "cikarang", "deltamas", "depok", "gading serpong", "grand wisata", "jatiasih", "kalideres", "kelapa gading", "kemayoran", "pamulang"), most="medium"),
        Source("hermina", ("tangerang", "daan mogot", "jatinegara", "bogor", "bekasi", "grand wisata", "depok", "mekarsari", "kemayoran", "podomoro", "galaxy", "ciputat", "ciledug", "cikarang", "bintaro", "serpong")),
        Source("rs_pondok_indah", ("puri indah", "bintaro"), ("surabaya",), ends="- pondok indah"),
        Source("brawijaya", most="medium"),
        Source("sentra_medika", ("cibinong", "cisalak", "harapan bunda", "cikarang"), most="medium"),
        Source("primaya", ("jakarta", "bekasi", "tangerang", "bogor", "depok", "cikarang", "karawang"), ("makassar", "palangkaraya", "sorowako", "sukabumi", "pangkalpinang", "semarang", "bandung", "hertasning")),
        Source("emc", ("alam sutera", "cibitung", "cikarang", "grha kedoya", "pekayon", "pulomas", "sentul", "tangerang")),
        Source("mayapada", ("jakarta", "tangerang", "bogor", "kuningan"), ("surabaya", "bandung", "nusantara")),
        Source("bethsaida", ("gading serpong",), ("serang",)),
        Source("columbia_asia", ("bsd", "pulomas")),
        Source("radjak", outside=("radjak hospital purwakarta",)),
        Source("sari_asih", outside=("rs sari asih serang",)),
        Source("rs_premier"),
        Source("eka", ("mt haryono", "permata hijau", "pluit", "bsd", "cibubur", "depok", "bekasi", "pik"), ("pekanbaru",)),
    )
}


def _raw(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(*[(F.lit(source) if c == "source" else columns.get(c, none).cast("string")).alias(c) for c in RAW])


def _json(df: DataFrame, schema: str, field: str = "data") -> DataFrame:
    """Elements of an array field of each JSON document; broken documents give none."""
    return df.select(F.explode(F.from_json("payload", f"{field} array<{schema}>")[field]).alias("d")).select("d.*")


def _names(x: Column | str) -> Column:
    """Names that are not empty, each once."""
    return F.array_distinct(F.filter(x, lambda n: n.isNotNull() & (n != "")))


def near(source: Source, branch: Column, address: Column | None = None) -> Column:
    """Whether a branch is in scope: not outside by name, no hint against it, then any hint for it."""
    low = F.lower(F.trim(F.coalesce(branch, F.lit(""))))
    hit = in_region(branch, source.allow, source.deny) if source.allow else in_region(F.concat(F.lit("."), branch), (".",), source.deny)
    if source.ends:
        hit = hit | (low.endswith(source.ends) & ~in_region(branch, source.deny))
    if address is not None and source.address:
        hit = hit | in_region(address, source.address)
    return hit & ~low.isin(*source.outside) if source.outside else hit


def siloam(listing: DataFrame, schedules: DataFrame) -> DataFrame:
    """Records with several branches share all their sessions; a record stays if any branch is near, with or without
    sessions. Whose schedule a payload is follows from a column doctor_id of schedules, else from the payload's doctor, else from
    its sessions."""
    s = SOURCES["siloam"]
    people = _json(listing, "struct<doctor_id:string,name:string,specialization_name:string>").filter("doctor_id IS NOT NULL")
    kind = "data struct<doctor:struct<doctor_id:string>,availability:array<struct<hospital_name:string,hospital_address:string>>,schedule:array<struct<doctor_id:string,day:int,from_time:string,to_time:string>>>"
    told = F.col("doctor_id") if "doctor_id" in schedules.columns else F.lit(None).cast("string")
    plans = schedules.select(told.cast("string").alias("told"), F.from_json("payload", kind)["data"].alias("d")).select("told", "d.*")
    plans = plans.withColumn("doctor_id", F.coalesce("told", "doctor.doctor_id", F.get("schedule", 0)["doctor_id"])).drop("doctor")
    keep = F.exists("availability", lambda a: near(s, a["hospital_name"], a["hospital_address"]))
    rows = people.join(plans.filter(keep), "doctor_id").select("doctor_id", "name", "specialization_name", "schedule", F.explode(F.array_distinct(F.transform("availability", lambda a: a["hospital_name"]))).alias("branch"))
    rows = rows.select("*", F.explode_outer("schedule").alias("t"))
    return _raw(rows, s.name, record=F.col("doctor_id"), raw_name=F.col("name"), credentials=F.col("specialization_name"), branch=F.col("branch"), day_text=F.col("t.day"), start_text=F.col("t.from_time"), end_text=F.col("t.to_time"))


def mitra_keluarga(listing: DataFrame) -> DataFrame:
    """Dated bookings; one branch per record."""
    s = SOURCES["mitra_keluarga"]
    d = _json(listing, "struct<ref_id:string,doctor:struct<name:string,slug:string>,clinic:struct<name:string>,speciality:struct<name:string>,schedules:array<struct<day:string,start_time:string,end_time:string,on_leave:boolean>>>")
    rows = d.filter(F.col("clinic.name").isNotNull() & near(s, F.col("clinic.name"))).select("*", F.explode_outer(F.filter("schedules", lambda x: ~F.coalesce(x["on_leave"], F.lit(False)))).alias("t"))
    return _raw(rows, s.name, record=F.col("ref_id"), raw_name=F.col("doctor.name"), credentials=F.col("speciality.name"), branch=F.col("clinic.name"), day_text=F.col("t.day"), start_text=F.col("t.start_time"), end_text=F.col("t.end_time"))


def hermina(listing: DataFrame, schedules: DataFrame) -> DataFrame:
    """Sessions by branch and clinic; a record stays if any of its locations is near. schedules has slug. A record without
    a schedule keeps all its locations."""
    s = SOURCES["hermina"]
    d = _json(listing, "struct<attributes:struct<full_name:string,slug:string,speciality:string,practic_locations:array<string>>>").select("attributes.*")
    kept = d.filter(F.col("slug").isNotNull() & F.exists("practic_locations", lambda x: near(s, x)))
    kind = "data map<string,map<string,array<struct<day:string,from_time:string,to_time:string>>>>"
    a = schedules.select("slug", F.explode(F.from_json("payload", kind)["data"]).alias("branch", "clinics"))
    b = a.select("slug", "branch", F.explode("clinics").alias("clinic", "sessions")).select("slug", "branch", F.explode("sessions").alias("t"))
    rows = kept.join(b, "slug", "left").withColumn("branch", F.explode_outer(F.when(F.col("branch").isNotNull(), F.array("branch")).otherwise(_names("practic_locations"))))
    return _raw(rows, s.name, record=F.col("slug"), raw_name=F.col("full_name"), credentials=F.col("speciality"), branch=F.col("branch"), day_text=F.col("t.day"), start_text=F.col("t.from_time"), end_text=F.col("t.to_time"))


def rs_pondok_indah(listing: DataFrame) -> DataFrame:
    s = SOURCES["rs_pondok_indah"]
    d = _json(listing, "struct<fullname_doctor:string,doctor_code:string,specialty:string,doctor_schedule:array<struct<hospital:string,clinics:array<struct<clinic_name:string,schedules:array<struct<day:string,time_from:string,time_to:string>>>>>>>")
    kept = d.filter(F.exists("doctor_schedule", lambda h: near(s, h["hospital"])))
    a = kept.select("*", F.explode("doctor_schedule").alias("h")).select("*", F.explode_outer("h.clinics").alias("c")).select("*", F.explode_outer("c.schedules").alias("t"))
    return _raw(a, s.name, record=F.col("doctor_code"), raw_name=F.col("fullname_doctor"), credentials=F.col("specialty"), branch=F.col("h.hospital"), day_text=F.col("t.day"), start_text=F.col("t.time_from"), end_text=F.col("t.time_to"))


def brawijaya(branches: DataFrame, schedules: DataFrame) -> DataFrame:
    """schedules has rsid; specialists by name; the first record of a person and branch wins."""
    s = SOURCES["brawijaya"]
    b = _json(branches, "struct<rsid:int,name_hospital:string>")
    kind = "struct<specialist:string,doctors:array<struct<pid:long,dokter:string,schedules:array<struct<weekday:int,start_hour:string,start_minute:int,end_hour:string,end_minute:int>>>>>"
    d = schedules.select("rsid", F.explode(F.from_json("payload", f"data array<{kind}>")["data"]).alias("d")).select("rsid", "d.*")
    d = d.filter(F.lower("specialist").contains("dermat") | F.lower("specialist").contains("kulit")).select("rsid", "specialist", F.posexplode("doctors").alias("n", "p"))
    one = first_wins(d.withColumn("pid", F.col("p.pid")), ["pid", "rsid"], "n").join(b, "rsid").select("*", F.explode_outer("p.schedules").alias("t"))
    clock = lambda h, m: F.when(F.col(h).isNotNull(), F.format_string("%02d:%02d", F.col(h).try_cast("int"), F.coalesce(F.col(m), F.lit(0))))
    return _raw(one, s.name, record=F.col("pid"), raw_name=F.col("p.dokter"), credentials=F.col("specialist"), branch=F.col("name_hospital"), day_text=F.col("t.weekday"), start_text=clock("t.start_hour", "t.start_minute"), end_text=clock("t.end_hour", "t.end_minute"))


def sentra_medika(listing: DataFrame, schedules: DataFrame) -> DataFrame:
    """listing has spec and page; the last listing of an id wins; schedules has slug. A record without a schedule keeps
    all its hospitals."""
    s = SOURCES["sentra_medika"]
    kind = "struct<id:long,slug:string,full_name:string,specializations:array<struct<name:string>>,hospitals:array<struct<name:string>>>"
    d = listing.select("spec", "page", F.posexplode(F.from_json("payload", f"data array<{kind}>")["data"]).alias("pos", "d")).select("spec", "page", "pos", "d.*")
    one = last_write_wins(d, "id", ["spec", "page", "pos"]).filter(F.col("slug").isNotNull() & F.exists("hospitals", lambda h: near(s, h["name"])))
    plan = "data array<struct<polyclinic_name:string,hospitals:array<struct<hospital_name:string,schedules:array<struct<day:string,shifts:array<struct<start_time:string,end_time:string>>>>>>>>"
    a = schedules.select("slug", F.explode(F.from_json("payload", plan)["data"]).alias("c")).select("slug", F.explode("c.hospitals").alias("h")).select("slug", F.col("h.hospital_name").alias("branch"), F.explode("h.schedules").alias("x")).select("slug", "branch", F.col("x.day").alias("day"), F.explode("x.shifts").alias("t")).distinct()
    rows = one.join(a, "slug", "left").withColumn("branch", F.explode_outer(F.when(F.col("branch").isNotNull(), F.array("branch")).otherwise(_names(F.transform("hospitals", lambda h: h["name"])))))
    named = F.concat_ws(" ", "full_name", F.array_join(F.transform("specializations", lambda x: x["name"]), " "))
    return _raw(rows, s.name, record=F.col("id"), raw_name=F.col("full_name"), credentials=named, branch=F.col("branch"), day_text=F.col("day"), start_text=F.col("t.start_time"), end_text=F.col("t.end_time"))


def _sessions(cards: DataFrame, name: str, record: Column, specialist: Column | None = None) -> DataFrame:
    """Cards in scope as raw rows, an entry each; repeated cards of a record and branch fall together."""
    s = SOURCES[name]
    kept = cards.filter((F.col("name") != "") & near(s, F.col("branch")))
    if specialist is not None:
        kept = kept.filter(specialist)
    keyed = kept.withColumns({"__r": record, "__b": F.lower(F.coalesce("branch", F.lit("")))})
    rows = first_wins(keyed, ["__r", "__b"], F.struct("url", "card")).select("*", F.explode_outer("entries").alias("e"))
    return _raw(
        rows, name, record=F.col("__r"), raw_name=F.col("name"), credentials=F.col("credentials"), branch=F.coalesce("e.branch", "branch"), day_text=F.col("e.day"), start_text=F.col("e.start"), end_text=F.col("e.end"),
        time_text=F.col("e.time"), source_url=F.coalesce(F.nullif(F.col("detail"), F.lit("")), "url"),
    )


def pages_of(name: str, html: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Sources whose listing names the branch. html: url, html. A record is a source's own id where its pages have one, else
    the person's name. details (record, html), where a source has them, hold the times by branch: their branches stand in
    place of the listing's, which stay for records without times."""
    by_page = name in ("primaya", "sari_asih", "mayapada")
    checks = {"radjak": (F.col("credentials") != "") & is_specialist(F.col("name")), "sari_asih": is_specialist(F.col("name"))}
    found = cards.read(html, name)
    if details is not None:
        found = _with_times(found, details, name).withColumn("entries", F.coalesce("own", "entries"))
    return _sessions(found, name, F.col("record") if by_page else F.lower(collapse(F.col("name"))), checks.get(name))


def _with_times(found: DataFrame, details: DataFrame, name: str) -> DataFrame:
    """Cards plus what their page of their own says: own (entries), own_branch, own_special."""
    page = cards.read(details.withColumnRenamed("record", "of"), f"{name}_detail")
    return found.join(page.select("of", F.col("entries").alias("own"), F.col("branch").alias("own_branch"), F.col("credentials").alias("own_special")), F.col("record") == F.col("of"), "left")


#: What the pages of doctors call the branches of the listing.
CALLED = {"RSCA BSD": "RS Columbia Asia BSD", "RSCA Pulomas": "RS Columbia Asia Pulomas"}


def detailed(name: str, listing: DataFrame, details: DataFrame) -> DataFrame:
    """Sources whose times stand on a page of their own. listing: url, html, branch; details: record, html.

    A page of columbia_asia that names another branch or another specialty than the listing gives no times; the record
    stays without them.
    """
    found = cards.read(listing.withColumnRenamed("branch", "told"), name).withColumn("branch", F.col("told"))
    joined = _with_times(found, details, name)
    special = F.col("name")
    if name == "columbia_asia":
        special = F.col("credentials")
        called = F.try_element_at(F.create_map(*[F.lit(x) for kv in CALLED.items() for x in kv]), F.col("own_branch"))
        fits = (F.lower(called) == F.lower("branch")) & is_specialist(F.col("own_special"))
        joined = joined.withColumn("own", F.when(F.col("of").isNull() | fits, F.col("own")).otherwise(F.array().cast(joined.schema["own"].dataType)))
    return _sessions(joined.withColumn("entries", F.coalesce("own", "entries")), name, F.col("record"), is_specialist(special))


#: name -> function of its frames.
REGISTRY = {
    "siloam": siloam, "mitra_keluarga": mitra_keluarga, "hermina": hermina, "rs_pondok_indah": rs_pondok_indah, "brawijaya": brawijaya, "sentra_medika": sentra_medika,
    **{n: partial(pages_of, n) for n in ("primaya", "emc", "mayapada", "bethsaida", "radjak", "sari_asih", "eka")},
    **{n: partial(detailed, n) for n in ("columbia_asia", "rs_premier")},
}


def all_sources(frames: dict[str, tuple[DataFrame, ...]]) -> DataFrame:
    """Raw rows of every source that has payloads, in one frame."""
    if not frames or not frames.keys() <= REGISTRY.keys():
        raise ValueError(f"unknown sources {sorted(frames.keys() - REGISTRY.keys())}")
    return reduce(DataFrame.unionByName, [REGISTRY[n](*f) for n, f in sorted(frames.items())])

"""The dimension of sensitive types, and lookups of names and aliases in it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Type names, subsets, aliases and normal forms that results must carry.
TYPES = (
    "NAME", "DATE", "LOCATION", "ID", "MEDICAL_RECORD_NUMBER", "ACCOUNT_NUMBER", "CONTACT", "PHONE", "FAX", "EMAIL", "URL", "IP_ADDRESS",
    "AGE_OVER_89", "AGE_OVER_90", "BIOMETRIC", "PHOTO", "HOSPITAL_NAME", "DEPARTMENT_NAME", "WARD_NUMBER", "BED_NUMBER", "RARE_DISEASE",
    "GENETIC_INFO", "DEVICE_ID", "CERTIFICATE", "SSN", "INSURANCE_NUMBER", "CUSTOM", "OTHER",
)
STANDARD = ("NAME", "DATE", "LOCATION", "MEDICAL_RECORD_NUMBER", "CONTACT", "AGE_OVER_89", "BIOMETRIC")
STRICT = (*STANDARD, "AGE_OVER_90", "HOSPITAL_NAME", "WARD_NUMBER", "RARE_DISEASE", "PHONE", "EMAIL")
AGE_RELATED = ("AGE_OVER_89", "AGE_OVER_90")
FACILITY_RELATED = ("HOSPITAL_NAME", "DEPARTMENT_NAME", "WARD_NUMBER", "BED_NUMBER")
HIGH_RISK = ("RARE_DISEASE", "AGE_OVER_90", "BIOMETRIC", "GENETIC_INFO", "SSN")
LANGUAGES = ("zh-TW", "zh-CN", "en", "ja", "ko", "fr", "de", "es", "vi", "th")
ALIASES: dict[str, tuple[str, ...]] = {
    "NAME": ("姓名", "名字", "患者姓名", "病人姓名", "醫師姓名", "醫生姓名", "name", "patient_name"),
    "DATE": ("日期", "出生日期", "就診日期", "住院日期", "date", "birth_date"),
    "AGE_OVER_89": ("年齡", "歲數", "年齡超過89歲", "age", "age_over_89"),
    "AGE_OVER_90": ("年齡超過90歲", "age_over_90"),
    "LOCATION": ("地址", "地點", "位置", "住址", "小型地理區域", "地理區域", "地理位置", "address", "location"),
    "PHONE": ("電話", "電話號碼", "聯絡電話", "手機", "phone", "mobile"),
    "FAX": ("傳真", "傳真號碼", "fax"),
    "EMAIL": ("電子郵件", "郵件", "email", "e-mail"),
    "CONTACT": ("聯絡資訊", "contact", "contact_info"),
    "ID": ("身份證號碼", "身分證字號", "識別碼", "識別資訊", "id", "identifier"),
    "MEDICAL_RECORD_NUMBER": ("病歷號", "病歷號碼", "醫療記錄號", "mrn", "medical_record"),
    "ACCOUNT_NUMBER": ("帳號", "帳戶號碼", "account", "account_number"),
    "INSURANCE_NUMBER": ("保險號碼", "醫療保險號碼", "醫療保險id", "健保卡號", "insurance", "insurance_id"),
    "HOSPITAL_NAME": ("醫院", "醫院名稱", "醫療機構", "醫療機構名稱", "組織名稱", "組織資訊", "hospital", "facility"),
    "DEPARTMENT_NAME": ("科室", "科室名稱", "department"),
    "WARD_NUMBER": ("病房號", "ward", "ward_number"),
    "BED_NUMBER": ("床號", "bed", "bed_number"),
    "RARE_DISEASE": ("罕見疾病", "診斷", "rare_disease"),
    "GENETIC_INFO": ("基因資訊", "遺傳資訊", "genetic", "genetic_info"),
    "PHOTO": ("照片", "photo", "photograph"),
    "BIOMETRIC": ("生物特徵", "指紋", "biometric", "fingerprint"),
    "DEVICE_ID": ("設備識別碼", "裝置識別碼", "device", "device_id"),
    "CERTIFICATE": ("證書", "證書號碼", "執照號碼", "certificate", "license"),
    "URL": ("網址", "url", "website"),
    "IP_ADDRESS": ("ip位址", "ip地址", "ip", "ip_address"),
    "SSN": ("社會安全號碼", "社安號", "ssn", "social_security"),
}
#: words by which a model's short answers name types; the first that occurs in the answer decides
KEYWORDS: dict[str, str] = {
    "person": "NAME", "name": "NAME", "patient": "NAME", "date": "DATE", "dob": "DATE", "birthday": "DATE", "phone": "PHONE", "tel": "PHONE", "mobile": "PHONE",
    "email": "EMAIL", "mail": "EMAIL", "id": "ID", "ssn": "ID", "mrn": "ID", "account": "ID", "address": "LOCATION", "location": "LOCATION", "city": "LOCATION", "org": "FACILITY", "hospital": "FACILITY", "company": "FACILITY",
}
#: the shorter normal forms of two evaluations: of lightweight models, and of case matching
LIGHT_FORMS: dict[str, tuple[str, ...]] = {
    "NAME": ("PERSON", "PATIENT", "DOCTOR", "PERSON_NAME", "PATIENT_NAME"), "DATE": ("DATETIME", "DOB", "BIRTHDATE"), "PHONE": ("TELEPHONE", "PHONE_NUMBER"),
    "LOCATION": ("ADDRESS",), "ID": ("MEDICAL_RECORD", "MRN"), "FACILITY": ("HOSPITAL", "CLINIC"),
}
CASE_FORMS: dict[str, tuple[str, ...]] = {
    "NAME": ("NAME", "PATIENT_NAME", "DOCTOR_NAME"), "AGE": ("AGE", "AGE_OVER_89"), "DATE": ("DATE", "DOB", "BIRTHDATE"), "ID": ("ID", "ID_NUMBER", "MRN"),
    "PHONE": ("PHONE", "TELEPHONE", "MOBILE"), "EMAIL": ("EMAIL",), "LOCATION": ("LOCATION", "ADDRESS"), "FACILITY": ("FACILITY", "HOSPITAL"),
}
#: names of evaluation corpora, by their normal form; a fixed value like the ones above
NORMAL_FORMS: dict[str, tuple[str, ...]] = {
    "NAME": ("NAME", "PATIENT", "PATIENT_NAME", "DOCTOR", "DOCTOR_NAME", "PERSON", "PERSON_NAME", "FULL_NAME", "PERSON/NAME"),
    "DATE": ("DATE", "DOB", "BIRTHDATE", "DATE_OF_BIRTH", "DATE_TIME", "DATETIME"),
    "AGE": ("AGE", "AGE_OVER_89"),
    "ID": ("ID", "ID_NUMBER", "MRN", "SSN", "MEDICALRECORD", "IDNUM", "CREDIT_CARD", "CREDIT_CARD_NUMBER", "ID/SSN"),
    "PHONE": ("PHONE", "TELEPHONE", "MOBILE", "FAX", "PHONE_NUMBER"),
    "EMAIL": ("EMAIL", "EMAIL_ADDRESS"),
    "LOCATION": ("LOCATION", "ADDRESS", "STREET", "CITY", "STATE", "ZIP", "COUNTRY", "STREET_ADDRESS", "GPE", "LOCATION/GPE"),
    "FACILITY": ("FACILITY", "HOSPITAL", "ORGANIZATION"),
    "OTHER": ("NRP", "TITLE"),
}


def literal_map(pairs: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)])


def type_table(spark: SparkSession, custom: DataFrame | None = None) -> DataFrame:
    """name, source (base or custom), standard, strict, age_related, facility_related, high_risk.  ``custom``: name, high_risk."""
    base = spark.createDataFrame([(t,) for t in TYPES], "name string").select("name", F.lit("base").alias("source"), F.col("name").isin(*HIGH_RISK).alias("high_risk"))
    if custom is not None:  # names that are there already are not registered again
        base = base.unionByName(custom.select("name", F.lit("custom").alias("source"), "high_risk").dropDuplicates(["name"]).join(base.select("name"), "name", "left_anti"))
    sets = {"standard": STANDARD, "strict": STRICT, "age_related": AGE_RELATED, "facility_related": FACILITY_RELATED}
    return base.withColumns({k: F.col("name").isin(*v) for k, v in sets.items()})


def discovered(seen: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct type names in ``seen`` (phi_type) that ``known`` (name) lacks."""
    return seen.select(F.col("phi_type").alias("name")).distinct().join(known.select("name"), "name", "left_anti")


def map_alias(name: Column, extra: Mapping[str, str] | None = None) -> Column:
    """struct(phi_type, custom_type): the caller's own mapping (``extra``), else type name, else alias, else CUSTOM with the name."""
    clean = F.trim(name)
    upper = F.translate(F.upper(clean), " -", "__")
    aliases = literal_map({a: t for t, names in ALIASES.items() for a in names})
    found = F.coalesce(F.when(upper.isin(*TYPES), upper), F.try_element_at(aliases, F.lower(clean)))
    if extra:
        found = F.coalesce(F.try_element_at(literal_map(extra), clean), found)
    blank = name.isNull() | (clean == "")
    kind = F.when(blank, F.lit("CUSTOM")).otherwise(F.coalesce(found, F.lit("CUSTOM")))
    custom = F.when(blank, F.lit("Unknown PHI Type")).when(found.isNull(), clean)
    return F.struct(kind.alias("phi_type"), custom.alias("custom_type"))


def prefixed_custom(name: Column) -> Column:
    """The name behind ``CUSTOM:``, null where there is none."""
    return F.when(F.upper(name).startswith("CUSTOM:"), F.trim(F.substring(name, F.lit(8), F.char_length(name))))


def custom_name(name: Column, text: Column) -> Column:
    """A custom type's name; without one, made from the start of the entity."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("Custom PHI: "), F.substring(text, 1, 50)))


def normal_form(name: Column) -> Column:
    """Normalised type name of evaluation corpora; unknown names stay, upper-cased."""
    upper = F.translate(F.upper(name), " -", "__")
    return F.coalesce(F.try_element_at(literal_map({n: k for k, names in NORMAL_FORMS.items() for n in names}), upper), upper)


def short_form(name: Column, forms: Mapping[str, tuple[str, ...]]) -> Column:
    """Normal form by one of the shorter tables; unknown names stay, upper-cased."""
    return F.coalesce(F.try_element_at(literal_map({n: k for k, names in forms.items() for n in names}), F.upper(name)), F.upper(name))


def keyword_type(answer: Column) -> Column:
    """Type of a model's short answer: that of the first keyword (in their order) that it holds, else the answer upper-cased."""
    bare = F.translate(F.lower(answer), " _", "")
    out = F.when(F.lit(False), answer)
    for word, kind in KEYWORDS.items():
        out = out.when(bare.contains(word), F.lit(kind))
    return out.otherwise(F.upper(answer))


def is_supported(language: Column) -> Column:
    """Whether a language is one of those that are supported; null counts as the default."""
    return F.coalesce(language, F.lit(LANGUAGES[0])).isin(*LANGUAGES)


def display_name(phi_type: Column, custom_type: Column) -> Column:
    return F.when((phi_type == "CUSTOM") & custom_type.isNotNull(), custom_type).otherwise(phi_type)


def description(phi_type: Column, custom_type: Column, text: Column, custom_description: Column, source: Column) -> Column:
    """'type: text (description of the custom type) [Source: regulation]'."""
    more = F.when(custom_type.isNotNull(), F.concat(F.lit(" ("), custom_description, F.lit(")")))
    return F.concat(display_name(phi_type, custom_type), F.lit(": "), text, F.coalesce(more, F.lit("")), F.coalesce(F.concat(F.lit(" [Source: "), F.nullif(source, F.lit("")), F.lit("]")), F.lit("")))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Entities of a model's answer (phi_type, text, start_pos, end_pos, confidence, reason) with what is missing filled in."""
    values = {"phi_type": "NAME", "start_pos": 0, "end_pos": 0, "confidence": 1.0, "reason": "Identified as PHI"}
    out = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()}
    out["reason"] = F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit(values["reason"]))
    return rows.withColumns(out)


def export_types(types: DataFrame, path: str) -> None:
    """Custom and discovered types as JSON lines."""
    types.filter("source <> 'base'").write.mode("overwrite").json(path)


def import_types(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """The known types and those of an export that are not known yet."""
    read = spark.read.schema(known.schema).json(path)
    return known.unionByName(read.dropDuplicates(["name"]).join(known.select("name"), "name", "left_anti"))


def without_discovered(types: DataFrame) -> DataFrame:
    return types.filter("source <> 'discovered'")


def is_high_risk(phi_type: Column, custom: Column | None = None) -> Column:
    risky = phi_type.isin(*HIGH_RISK)
    return risky if custom is None else risky | F.coalesce(custom, F.lit(False))


def matches_custom(text: Column, examples: list[str], aliases: list[str], pattern: str | None) -> Column:
    """An example of a custom type, or a text with one of its aliases, or one its pattern matches from the start."""
    found = text.isin(*examples) if examples else F.lit(False)
    for a in aliases:
        found = found | F.lower(text).contains(a.lower())
    return found | text.rlike(f"^(?:{pattern})") if pattern else found


def render_types(types: DataFrame) -> DataFrame:
    """One row with the type names as a list, as JSON and as markdown."""
    names = F.array_sort(F.collect_list("name"))
    return types.agg(names.alias("n")).select(
        F.array_join("n", ", ").alias("list"), F.to_json("n").alias("json"), F.array_join(F.transform("n", lambda x: F.concat(F.lit("- "), x)), "\n").alias("markdown")
    )

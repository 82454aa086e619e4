"""Comparison of texts, islands of tags, identifiers' confidences, presets, office files whose values stand across runs, sheets by relation."""

import io
import json
import zipfile

from maskwright.operators import evaluation, identifiers, masking
from maskwright.sources import documents, outputs


def test_texts_are_compared_stripped_and_lower_cased(spark):
    gold = spark.createDataFrame([(1, 1, "Bob ", "PERSON"), (1, 2, "x", "DOB")], "sample_id int, seq int, text string, phi_type string")
    found = spark.createDataFrame([(1, 1, "bob", "NAME"), (1, 2, "\tX\n", "DATE"), (1, 3, "bob", "NAME")], gold.schema)
    row = evaluation.exact(gold, found).first()
    assert (row.tp, row.fp, row.fn) == (2, 1, 0)
    row = evaluation.partial(gold, found).first()
    assert (row.tp, row.fp, row.fn) == (2, 1, 0)


def test_islands_of_tags(spark):
    tags = {1: "O I-LOC B-PER I-LOC", 2: "I-PER B-LOC B-LOC I-LOC O I-LOC", 3: "B-ORG I-PER B-PER"}
    rows = [(d, i, f"t{i}", t) for d, s in tags.items() for i, t in enumerate(s.split())]
    out = evaluation.bio_entities(spark.createDataFrame(rows, "doc_id int, pos int, token string, tag string")).collect()
    assert sorted((r.doc_id, r.phi_type, r.text) for r in out) == [(1, "PER", "t2 t3"), (2, "LOC", "t1"), (2, "LOC", "t2 t3"), (3, "PER", "t2")]


def test_identifiers_keep_their_confidence_unvalidated(spark):
    df = spark.createDataFrame([("A123456789 A123456788 AB12345678",)], "text string")
    for validate, other in ((True, 0.6), (False, 0.7)):
        row = df.select(identifiers.id_spans(df.text, validate).alias("s")).first()
        assert [(s.confidence, s.rule_id) for s in row.s] == [(0.99, "TW_NATIONAL_ID"), (other, "TW_NATIONAL_ID"), (0.95, "TW_ARC")]


def test_presets():
    hipaa, minimal, research = (masking.preset(n) for n in ("hipaa_standard", "minimal", "research_safe"))
    assert {"LICENSE", "VEHICLE", "DEVICE", "BIOMETRIC", "PHOTO", "CERTIFICATE", "DEVICE_ID", "MEDICAL_RECORD_NUMBER"} <= set(hipaa.types)
    assert minimal.types["MEDICAL_RECORD_NUMBER"].enabled and set(minimal.types) == {"NAME", "ID_NUMBER", "SSN", "MEDICAL_RECORD", "ID", "MEDICAL_RECORD_NUMBER"}
    assert not research.types["DATE"].enabled and research.masking_of("NAME") == "hash" and research.masking_of("PHONE") == "mask"
    again = masking.from_json(masking.to_json(research))
    assert again.types == dict(sorted(research.types.items())) and again.secret is None and "secret" not in json.loads(masking.to_json(research))


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_values_across_runs_are_masked():
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>To An</w:t></w:r><w:r><w:t xml:space="preserve">na &amp; Bo</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>'
    new = outputs.patched("docx", packed({"word/document.xml": body}), [("Anna", "N"), ("Bob", "M")])
    assert documents.docx_text(new) == "To N & Bo\nb"


def test_sheets_are_found_by_relation():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda v: f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="inlineStr"><is><t>skip</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>h</t></is></c></row><row><c r="A3" t="inlineStr"><is><t>{v}</t></is></c></row></sheetData></worksheet>'
    book = packed({
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="one" sheetId="1" r:id="rId2"/><sheet name="two" sheetId="2" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet("second"), "xl/worksheets/sheet2.xml": sheet("first"),
    })
    assert documents.sheet_reader("two", skip=1)(book) == "[two] h: second"
    assert documents.sheet_reader(skip=1)(book) == "[one] h: first\n[two] h: second"
    assert documents.csv_reader()(b"a,b\n1,\"x, y\"\n2\n") == "a: 1, b: x, y\na: 2, b: " and documents.csv_reader(header=False)(b"1,2\n") == "1, 2"

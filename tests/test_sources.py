"""Files: encodings, records in five dialects, DOCX with bounds."""

import io
import zipfile

import pytest

from tessera.sources import decoding, documents, records

RIS = "TY  - JOUR\r\nTI  - A study of\r\n  wrapped titles\r\nAU  - Ada, A.\r\nAU  - Bob, B.\r\nPY  - 2019/03\r\nSP  - 12\r\nEP  - 20\r\nDO  - 10.1/x\r\nER  - \r\n\r\nTY  - JOUR\r\nTI  - Second\r\n"
PERCENT = "%0 Journal Article\n%T 多孔材料\n的研究\n%A 张三;李四\n%J 学报\n%D 2021-05-01\n%V 57\n%N 3\n%P 12-20\n%0 Journal Article\n%T Next\n%A A and B\n"
BIBTEX = '@article{k1,\n title = {On {Nested} braces},\n author = "Ada A and Bob B",\n year = 2020,\n pages = {1--2}\n}\n@misc{k2, title={Unclosed entry\n'
CITES = "[1]张三,李四.多孔材料的研究[J].材料学报,2021,57(03):12-20.\n【摘要】第一行\n第二行\n[2] Ada A. On things[M]. Berlin: Press, 1999.\n"


@pytest.mark.parametrize("name", ["utf-8", "utf-8-sig", "gb18030", "utf-16", "utf-16-le", "utf-16-be"])
def test_encodings(name):
    text = "%0 Journal\n%T 题目 and more latin letters\n%A Name\n"
    assert decoding.decode(text.encode(name))[0] == text


def test_odd_bytes():
    assert decoding.decode(None) == ("", "empty") and decoding.decode(b"")[0] == ""
    assert decoding.decode(b"ok \xff\xfe\x81")[1] in ("gb18030", "utf-8-loose")
    assert decoding.decode("学".encode("utf-8"))[1] == "utf-8"


def test_dialects():
    kind, ris = records.parse(RIS)
    assert kind == "ris" and [r["title"] for r in ris] == ["A study of wrapped titles", "Second"]
    assert ris[0]["authors"] == ["Ada, A.", "Bob, B."] and ris[0]["year"] == "2019" and ris[0]["pages"] == "12-20" and ris[0]["doi"] == "10.1/x"
    kind, percent = records.parse(PERCENT)
    assert kind == "percent" and percent[0]["title"] == "多孔材料的研究" and percent[0]["authors"] == ["张三", "李四"] and percent[0]["venue"] == "学报" and percent[1]["authors"] == ["A", "B"]
    kind, bib = records.parse(BIBTEX)
    assert kind == "bibtex" and [r["title"] for r in bib] == ["On Nested braces", "Unclosed entry"] and bib[0]["authors"] == ["Ada A", "Bob B"] and bib[0]["year"] == "2020"
    kind, cites = records.parse(CITES)
    assert kind == "plain" and cites[0]["authors"] == ["张三", "李四"] and cites[0]["venue"] == "材料学报" and (cites[0]["volume"], cites[0]["issue"], cites[0]["pages"]) == ("57", "3", "12-20")
    assert cites[0]["abstract"] == "第一行第二行" and cites[1]["venue"] == "Press" and cites[1]["year"] == "1999"
    assert records.parse("Just a text.\nWith lines.\n") == ("document", []) and records.parse("") == ("document", [])


def docx(xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_files(spark, tmp_path):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {space}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:delText>gone</w:delText><w:t>学</w:t></w:r></w:p></w:body></w:document>"
    made = {"a.docx": docx(body), "bomb.docx": docx(f"<w:document {space}>{' ' * 9_000_000}</w:document>"), "broken.docx": docx(body)[:40], "odd.docx": docx("<!DOCTYPE x [<!ENTITY a 'b'>]><x/>"), "n.md": "# 题".encode("gb18030"), "t.txt": b"plain", "refs.ris": RIS.encode("utf-16")}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in documents.read(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "One\ttwo\n学" and got["n.md"].text == "# 题" and got["n.md"].kind == "markdown" and got["t.txt"].text == "plain"
    assert all(got[x].text is None and got[x].problem for x in ("bomb.docx", "broken.docx", "odd.docx"))
    rows = records.read(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.format, r.title) for r in rows] == [("ris", "A study of wrapped titles"), ("ris", "Second")]
    assert {r.kind for r in documents.read(spark, str(tmp_path), most=1).collect()} == {"skipped"}

"""Texts of .docx and .odt packages (S8): golden cases."""

import io
import zipfile

import pytest

from shroud.plans.file_queries import packed_docx, packed_odt
from shroud.sources.parts import docx_text, odt_text

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="urn:mc" xmlns:v="urn:v" xmlns:wps="urn:wps"'


def package(member, xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member, xml)
    return out.getvalue()


def docx(body):
    return docx_text(package("word/document.xml", f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>'))


def odt(body):
    return odt_text(package("content.xml", f'<o:doc xmlns:o="urn:office" xmlns:t="urn:text" xmlns:table="urn:table" xmlns:draw="urn:draw">{body}</o:doc>'))


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


BOX = "<w:txbxContent>" + p("in box") + p("second") + "</w:txbxContent>"


@pytest.mark.parametrize("body, want", [
    ("", ""),
    (p("one") + p("") + p("three"), "one\n\nthree"),
    ("<w:p><w:r><w:t>Call</w:t><w:tab/><w:t>John</w:t><w:br/><w:t>Smith</w:t></w:r></w:p>", "Call\tJohn\nSmith"),
    ("<w:p><w:r><w:t>no</w:t><w:noBreakHyphen/><w:t>break</w:t><w:softHyphen/><w:cr/></w:r></w:p>", "no-break\n"),
    ("<w:p><w:pPr><w:tabs><w:tab w:val='left'/></w:tabs></w:pPr><w:r><w:t>x</w:t></w:r></w:p>", "x"),
    ("<w:p><w:r><w:t>a</w:t></w:r><w:del><w:r><w:delText>gone</w:delText><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>b</w:t></w:r></w:ins></w:p>", "ab"),
    ("<w:p><w:r><w:instrText>PAGE</w:instrText><w:t>7</w:t></w:r></w:p>", "7"),
    ("<w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t><w:tab/></w:r><w:r><w:rPr><w:vanish w:val='0'/></w:rPr><w:t>seen</w:t></w:r></w:p>", "seen"),
    (f"<w:p><w:r><w:t>out</w:t></w:r><w:r><mc:AlternateContent><mc:Choice><wps:txbx>{BOX}</wps:txbx></mc:Choice>"
     f"<mc:Fallback><v:textbox>{BOX}</v:textbox></mc:Fallback></mc:AlternateContent></w:r><w:r><w:t>side</w:t></w:r></w:p>" + p("next"),
     "outside\nin box\nsecond\nnext"),
    ("<w:tbl><w:tr><w:trPr/><w:tc>" + p("a") + p("b") + "</w:tc><w:tc>" + p("c") + "</w:tc></w:tr><w:tr><w:tc>" + p("") + "</w:tc><w:tc>" + p("d") +
     "</w:tc></w:tr></w:tbl>" + p("after"), "a b\tc\n\td\nafter"),
    ("<w:tbl><w:tr><w:tc><w:tbl><w:tr><w:tc>" + p("x") + "</w:tc><w:tc>" + p("y") + "</w:tc></w:tr></w:tbl></w:tc><w:tc>" + p("z") + "</w:tc></w:tr></w:tbl>", "x y\tz"),
    ("<w:p><w:r><w:t>&lt;a&gt; &amp; ü \U0001f642</w:t></w:r></w:p>", "<a> & ü \U0001f642"),
    ("<w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:t xml:space='preserve'> end </w:t></w:r></w:p>", "link end "),
])
def test_docx(body, want):
    assert docx(body) == want


@pytest.mark.parametrize("body, want", [
    ("<t:h>Title</t:h><t:p>one<t:tab/>two<t:line-break/>three<t:s t:c='3'/>four</t:p>", "Title\none\ttwo\nthree   four"),
    ("<t:p>\n  spread over\n  lines <t:span> and </t:span> spans\n</t:p>", "spread over lines and spans "),
    ("<t:p>out<draw:frame><draw:text-box><t:p>in</t:p></draw:text-box></draw:frame>side</t:p><t:p>next</t:p>", "outside\nin\nnext"),
    ("<t:p>text<t:note><t:note-citation>1</t:note-citation><t:note-body><t:p>the note</t:p></t:note-body></t:note> goes on</t:p>", "text goes on\nthe note"),
    ("<t:p>a<o:annotation><t:p>comment</t:p></o:annotation>b</t:p>", "ab"),
    ("<t:tracked-changes><t:p>deleted</t:p></t:tracked-changes><t:p>kept</t:p>", "kept"),
    ("<table:table><table:table-row><table:table-cell><t:p>a</t:p><t:p>b</t:p></table:table-cell><table:table-cell><t:p>c</t:p></table:table-cell>"
     "</table:table-row></table:table>", "a b\tc"),
    ("<t:list><t:list-item><t:p>first</t:p></t:list-item><t:list-item><t:p>second</t:p></t:list-item></t:list>", "first\nsecond"),
    ("<t:p/>", ""),
])
def test_odt(body, want):
    assert odt(body) == want


def test_text_survives_both_packages():
    text = "Line one\n\n  two\twith  blanks & <tags> \nü\U0001f642\n"
    assert docx_text(packed_docx(text)) == text
    assert odt_text(packed_odt(text)) == text


def test_unpacking_is_bounded():
    data = packed_docx("x" * 3_000_000)
    assert len(data) < 20_000
    with pytest.raises(ValueError, match="unpacks"):
        docx_text(data, max_bytes=1_000_000)
    with pytest.raises(ValueError, match="unpacks"):
        odt_text(packed_odt("y" * 3_000_000), max_bytes=1_000_000)


@pytest.mark.parametrize("data", [b"", b"PK\x03\x04", package("other.xml", "<a/>"), package("word/document.xml", "<a><b></a>"), package("word/document.xml", "")])
def test_damaged_packages_raise(data):
    with pytest.raises(Exception):
        docx_text(data)


def test_deep_and_long_parts():
    body = "<w:tbl><w:tr><w:tc>" * 300 + p("deep") + "</w:tc></w:tr></w:tbl>" * 300 + p("x" * 1_000_000) + p("y") * 20_000
    lines = docx(body).split("\n")
    assert lines[0] == "deep" and len(lines[1]) == 1_000_000 and lines[2:] == ["y"] * 20_000

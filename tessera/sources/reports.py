"""Reports as HTML pages and texts as Word documents."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Mapping, Sequence

#: The parts that a Word document needs.
TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELATIONS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def docx(text: str) -> bytes:
    """A Word document with a paragraph for each line. Signs that XML cannot hold are left out; equal texts give equal bytes."""
    clean = "".join(c for c in text if c in "\t\n" or c >= " " and c not in "\ufffe\uffff" and not "\ud800" <= c <= "\udfff")
    rows = "".join(f'<w:p><w:r><w:t xml:space="preserve">{html.escape(x, quote=False)}</w:t></w:r></w:p>' for x in clean.split("\n"))
    body = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{rows}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in (("[Content_Types].xml", TYPES), ("_rels/.rels", RELATIONS), ("word/document.xml", body)):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def page(title: str, text: str, bands: Sequence[tuple[int, int, str]], rates: Mapping[str, float]) -> str:
    """A report: its rates, and the text with marked bands (start, end, kind), which do not overlap."""
    out, at = [], 0
    for a, b, kind in sorted(bands):
        out.append(html.escape(text[at:a]) + f'<mark class="{html.escape(kind)}">{html.escape(text[a:b])}</mark>')
        at = b
    out.append(html.escape(text[at:]))
    rows = "".join(f"<tr><td>{html.escape(n)}</td><td>{v:.2f}%</td></tr>" for n, v in rates.items())
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>{rows}</table><pre>{''.join(out)}</pre></body></html>"

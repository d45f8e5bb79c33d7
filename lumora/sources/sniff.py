"""Format, encoding and separator of a file, from its first bytes. Runs in Python workers, so that nothing large is imported."""

from __future__ import annotations

#: Bytes of a file that tell its format, encoding and separator, at any size.
HEAD_BYTES = 10_000

# Known extensions, trial encodings and separators.
FORMATS = {
    "csv": "csv", "tsv": "tsv", "txt": "csv", "json": "json", "parquet": "parquet", "xml": "xml", "html": "html", "xlsx": "xlsx",
}
ENCODINGS = ["utf-8", "latin-1", "cp1252", "iso-8859-1"]
SEPARATORS = [",", ";", "\t", "|"]


def detect_encoding(head: bytes) -> str:
    """First trial encoding that decodes the head; a character cut at its end does not count as a failure."""
    for name in ENCODINGS:
        try:
            head.decode(name)
            return name
        except UnicodeDecodeError as e:
            if e.start >= len(head) - 3 and len(head) >= HEAD_BYTES:
                return name
    return "utf-8"


def detect_separator(line: str) -> str:
    """Most frequent trial separator of the first line; comma when none occurs."""
    counts = [(line.count(s), -i, s) for i, s in enumerate(SEPARATORS)]
    best = max(counts)
    return best[2] if best[0] else ","


def sniff_head(path: str, head: bytes) -> dict:
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    encoding = detect_encoding(head)
    line = (head.decode(encoding, errors="replace").splitlines() or [""])[0]
    fmt, error = FORMATS.get(ext), None
    if fmt is None or ext == "txt":
        if line.count(",") > 1 or fmt is not None and any(s in line for s in SEPARATORS):
            fmt = "csv"
        else:
            fmt, error = None, f"unknown format: .{ext}"
    sep = "\t" if fmt == "tsv" else detect_separator(line) if fmt == "csv" else None
    header = line if fmt in ("csv", "tsv") else None
    if fmt in ("csv", "tsv", "json", "xml") and not head.strip():
        error = "empty file"
    return {"path": path, "format": fmt, "encoding": encoding, "separator": sep, "header": header, "error": error}


SNIFF_SCHEMA = "path string, format string, encoding string, separator string, header string, error string"

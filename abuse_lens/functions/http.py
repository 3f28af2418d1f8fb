"""HTTP heads and JSON-RPC envelopes: Column forms and the small byte helpers
the framing tasks share."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the parser.
MAX_HEAD_BYTES = 16 * 1024
MAX_HEADERS = 64
MAX_BUFFER_BYTES = 1024 * 1024
BODY_KEEP_BYTES = 8 * 1024

TOKEN = rb"[!#$%&'*+\-.^_`|~0-9A-Za-z]"
_REQUEST = re.compile(rb"%s+ [\x21-\x7e\x80-\xff]+ HTTP/1\.[01]\r?" % TOKEN)
_RESPONSE = re.compile(rb"HTTP/1\.[01] (\d{3})( [\t\x20-\x7e\x80-\xff]*)?\r?")
_HEADER = re.compile(rb"(%s+):([\t\x20-\x7e\x80-\xff]*)\r?" % TOKEN)
# Beginnings of a line that may still become valid.
_REQUEST_START = re.compile(rb"%s*|%s+ [\x21-\x7e\x80-\xff]*|%s+ [\x21-\x7e\x80-\xff]+ [HTP/1.0]*\r?" % (TOKEN, TOKEN, TOKEN))
_RESPONSE_START = re.compile(rb"[HTP/1.0]*|HTTP/1\.[01] \d{0,3}|HTTP/1\.[01] \d{3}( [\t\x20-\x7e\x80-\xff]*)?\r?")
_HEADER_START = re.compile(rb"%s*|%s+:[\t\x20-\x7e\x80-\xff]*\r?|\r" % (TOKEN, TOKEN))
_HTTP_NAME = (b"HTTP/1.0", b"HTTP/1.1")


def _may_begin(line: bytes, response: bool) -> bool:
    if not (_RESPONSE_START if response else _REQUEST_START).fullmatch(line):
        return False
    version = line if response else (line.split(b" ") + [b"", b""])[2]
    version = version.rstrip(b"\r")[:8]
    return any(name.startswith(version) for name in _HTTP_NAME)


def parse_head(data: bytes, response: bool) -> tuple[int, int, int | None] | bool:
    """Head length, Content-Length and status of a complete head.

    True while more bytes may complete it, False once they cannot.  Blank lines
    before the first line are skipped; a missing or unusable Content-Length
    counts as 0.
    """
    at = 0
    while data.startswith((b"\r\n", b"\n"), at):
        at += 2 if data[at] == 13 else 1
    end = data.find(b"\n", at)
    if end < 0:
        return _may_begin(data[at:], response) and len(data) <= MAX_HEAD_BYTES
    first = (_RESPONSE if response else _REQUEST).fullmatch(data[at:end])
    if not first:
        return False
    status = int(first.group(1)) if response else None
    length, headers = None, 0
    while True:
        at = end + 1
        end = data.find(b"\n", at)
        if end < 0:
            return bool(_HEADER_START.fullmatch(data[at:])) and len(data) <= MAX_HEAD_BYTES
        line = data[at:end]
        if line in (b"", b"\r"):
            return end + 1, length or 0, status
        header = _HEADER.fullmatch(line)
        headers += 1
        if not header or headers > MAX_HEADERS:
            return False
        if length is None and header.group(1).lower() == b"content-length":
            text = header.group(2).strip()
            # a longer number is no length; the next such header may be one
            if re.fullmatch(rb"\+?[0-9]+", text) and int(text) < 2**64:
                length = int(text)


def parse_envelope(body: bytes) -> tuple[bool, int | None]:
    """(is JSON-RPC, error code): a string ``jsonrpc`` is needed, a code must be an i32.

    A field that matters may be there once; what other objects repeat does not matter.
    """

    def strict(name: str):
        raise ValueError(name)  # NaN and Infinity are no JSON

    try:
        envelope = json.loads(body.decode("utf-8"), object_pairs_hook=_Fields, parse_constant=strict)
        if not isinstance(envelope, _Fields) or not isinstance(envelope.only("jsonrpc"), str):
            return False, None
        error = envelope.only("error")
        if error is None:
            return True, None
        code = error.only("code") if isinstance(error, _Fields) else True
    except (ValueError, RecursionError):
        return False, None
    if code is None:
        return True, None
    if isinstance(code, bool) or not isinstance(code, int) or not -(2**31) <= code < 2**31:
        return False, None
    return True, code


class _Fields(list):
    """An object's (name, value) pairs as they stand in the text."""

    def only(self, name: str):
        found = [v for n, v in self if n == name]
        if len(found) > 1:
            raise ValueError(f"duplicate {name}")
        return found[0] if found else None


def head_length(payload: Column) -> Column:
    """Bytes up to and including the blank line, null when the head is not complete."""
    at = F.locate("\r\n\r\n", F.decode(payload, "ISO-8859-1"))
    return F.when(at > 0, at + 3)


def content_length(payload: Column) -> Column:
    """Content-Length of a head that fits one payload; 0 when absent or unusable."""
    head = F.substring_index(F.decode(payload, "ISO-8859-1"), "\r\n\r\n", 1)
    digits = F.regexp_extract(head, r"(?im)^content-length:[ \t]*\+?(\d{1,18})[ \t]*\r?$", 1)
    return F.when(digits != "", digits).otherwise("0").cast("bigint")


def status_code(payload: Column) -> Column:
    code = F.regexp_extract(F.decode(payload, "ISO-8859-1"), r"^HTTP/1\.[01] (\d{3})", 1)
    return F.when(code != "", code).cast("int")


def rpc_envelope(body: Column) -> Column:
    """Struct (parsed, error_code) of a JSON body."""
    read = F.from_json(body, "jsonrpc string, error struct<code:int>")
    parsed = read["jsonrpc"].isNotNull()
    return F.struct(F.coalesce(parsed, F.lit(False)).alias("parsed"), F.when(parsed, read["error"]["code"]).alias("error_code"))

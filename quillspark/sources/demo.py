"""A small deterministic corpus of office files, with what searches over it must find."""

from __future__ import annotations

import random
from pathlib import Path

from quillspark.sources.samples import docx, eml

ACCOUNT = "61 1090 1014 0000 0712 1981 2874"
SPELLINGS = {"spaced": ACCOUNT, "dashed": ACCOUNT.replace(" ", "-"), "compact": ACCOUNT.replace(" ", "")}
DATE = ("15.03.2021", "2021-03-15", "15 marca 2021")
#: Documents that hold the account, and the date, in any spelling.
EXPECTED = {"account": 17, "date": 6, "broken": 4, "files": 24}
_TOPICS = ("zakup", "najem", "serwis", "dostawa", "szkolenie", "audyt", "transport", "ubezpieczenie")


def files(seed: int = 7) -> dict[str, bytes]:
    """Paths and contents: 9 spaced, 4 dashed and 4 compact accounts, three texts without one, four broken files."""
    r = random.Random(seed)
    spellings = ["spaced"] * 9 + ["dashed"] * 4 + ["compact"] * 4
    out: dict[str, bytes] = {}
    for i, how in enumerate(spellings):
        topic = _TOPICS[i % len(_TOPICS)]
        when = f" Data: {DATE[i % 3]}." if i < EXPECTED["date"] else ""
        text = f"Umowa {i + 1}: {topic}. Rachunek {SPELLINGS[how]}.{when} Kwota {r.randint(100, 999)},00 zł."
        kind = i % 4
        if kind == 0:
            out[f"umowy/umowa-{i:02}.docx"] = docx(f"Umowa na {topic}", text)
        elif kind == 1:
            out[f"listy/list-{i:02}.eml"] = eml(f"W sprawie: {topic}", text)
        elif kind == 2:
            out[f"notatki/notatka-{i:02}.txt"] = text.encode("cp1250")
        else:
            out[f"raporty/raport-{i:02}.html"] = f"<html><body><h1>{topic}</h1><p>{text}</p></body></html>".encode()
    for topic in ("procedura", "regulamin", "instrukcja"):
        out[f"procedury/{topic}.txt"] = f"Ogólna {topic} obiegu dokumentów.\n\nObowiązuje wszystkich.".encode()
    out["uszkodzone/pusty.txt"] = b" \n"
    out["uszkodzone/zly.docx"] = b"PK\x03\x04 to nie jest archiwum"
    out["uszkodzone/skan.pdf"] = b"%PDF-1.4 bez tekstu"
    out["uszkodzone/stary.doc"] = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(64)
    return out


def write(target: str) -> None:
    for path, data in files().items():
        file = Path(target, path)
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)

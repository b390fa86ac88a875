"""Licence windows of long templates against all windows, and their time on texts full of notices."""

import random
import time

import pyarrow as pa
import pytest

from sentrel.llm import license_scan

from .test_documents import brute_windows


@pytest.mark.parametrize("seed", range(3))
def test_long_templates_equal_all_windows(seed):
    """Templates of 60 and 220 words, damaged, repeated and cut in two, in texts of their own words."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(90)]
    notices = {"long": [" ".join(r.choices(words, k=220))], "middle": [" ".join(r.choices(words, k=60)), " ".join(r.choices(words[:20], k=45))]}
    parts = []
    for text in (notices["long"][0], notices["middle"][1], notices["middle"][0], notices["middle"][1]):
        own = text.split()
        for _ in range(len(own) // 12):
            own[r.randrange(len(own))] = r.choice(words)
        cut = r.randint(0, len(own))
        parts += [*r.choices(words, k=r.randint(0, 15)), *own[:cut], *r.choices(words, k=r.randint(0, 9)), *own[cut:]]
    text = " ".join(parts)
    library = license_scan.templates(notices)
    got = {(a, b, name, notice, round(dice, 9)) for _, a, b, name, notice, dice in license_scan.find(pa.array([text], pa.large_string()), library, 0.75)}
    assert got == brute_windows(text, notices, most=730) and len(got) > 3


def test_a_text_full_of_notices_takes_seconds():
    notice = " ".join(license_scan.TEMPLATES["MIT"][3:])
    text = "\n".join([notice] * 400)
    began = time.perf_counter()
    found = license_scan.find(pa.array([text], pa.large_string()), license_scan.templates(), license_scan.THRESHOLD)
    assert len([f for f in found if f[3] == "MIT" and f[4] == 3]) == 400 and time.perf_counter() - began < 30

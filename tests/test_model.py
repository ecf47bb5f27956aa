"""Random runs of an archive beside a plain model of it: what it lists, holds and extracts."""

import os
import random

import pytest

from shelfmark.errors import NoMatch
from shelfmark.operators import catalog as O
from shelfmark.plans.archive import Archive
from shelfmark.sources import tree as T


def content(rng):
    return bytes(rng.choice(b"abc") for _ in range(rng.choice((0, 1, 50)))) * rng.choice((1, 1, 200))


def change(rng, top, model):
    """A few edits of the tree, made to the model, too."""
    for _ in range(4):
        name = f"{rng.choice(('a', 'b', 'c/d'))}/{rng.randrange(4)}.txt"
        full = os.path.join(top, name)
        if rng.random() < 0.75 or name not in model:
            os.makedirs(os.path.dirname(full), exist_ok=True)
            if name in model and rng.random() < 0.3:
                os.unlink(full)  # no longer a second name of another file
            data = rng.choice([*model.values(), content(rng)])
            with open(full, "wb") as f:
                f.write(data)
            model[name] = data
        else:
            os.unlink(full)
            del model[name]


@pytest.mark.parametrize("seed", (1, 2))
def test_random_runs(spark, tmp_path, seed):
    rng = random.Random(seed)
    top, tree, held = str(tmp_path / "in"), {}, {}
    os.makedirs(top)
    change(rng, top, tree)
    archive = Archive(spark, str(tmp_path / "store"))
    archive.create(T.read_tree(spark, top), top, rng.choice(("zstd", "gzip", "none")), chunk=64)
    held |= tree
    used = set()
    for _ in range(4):
        step = rng.choice(("append", "append", "delete", "compact", "recompress"))
        if step == "append":
            change(rng, top, tree)
            archive.append(T.read_tree(spark, top), top, update="digest", spec=rng.choice(("zstd", "flate")), chunk=64)
            held |= tree
        elif step == "delete":
            gone = rng.choice(sorted(held)) if held else "a"
            try:
                archive.delete([gone])
                held.pop(gone, None)
            except NoMatch:
                assert gone not in held
        else:
            archive.compact(*([rng.choice(("xz", "zstd", "none"))] if step == "recompress" else []))
        rows = archive.rows().collect()
        live = {r["path"]: r for r in rows if not r["dead"] and r["type"] != "dir"}
        assert set(live) == set(held)
        ids = [r["id"] for r in rows]
        assert len(ids) == len(set(ids)) and (used := used | set(ids))
        assert O.violations(archive.rows(), max(1, len(archive.codecs())), strict=True).count() == 0
    assert all(r["ok"] for r in archive.verify().collect())
    archive.extract(str(tmp_path / "out"))
    for name, data in held.items():
        assert (tmp_path / "out" / name).read_bytes() == data, name

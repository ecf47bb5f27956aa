import pytest

from shelfmark.errors import Usage
from shelfmark.functions import settings as S

KNOWN = {"codec": "zstd:level=12", "chunk-size": "4MiB", "jobs": "0"}


def test_the_last_layer_wins(spark):
    file = S.parse_file("# mine\n\ncodec = gzip\njobs=2\n", KNOWN)
    env = S.from_environment({"SHELFMARK_CHUNK_SIZE": "1MiB", "SHELFMARK_JOBS": "3", "HOME": "/"}, KNOWN)
    got = S.table(spark, S.effective(KNOWN, file, env, {"jobs": "4"})).orderBy("key").collect()
    assert [tuple(r) for r in got] == [("chunk-size", "1MiB", "environment"), ("codec", "gzip", "file"), ("jobs", "4", "command line")]


@pytest.mark.parametrize("text, says", [("x = 1", ":1: unknown key"), ("jobs", ":1: no value"), ("jobs = 1\n\njobs = 2", ":3: repeated key")])
def test_bad_files(text, says):
    with pytest.raises(Usage, match=says):
        S.parse_file(text, KNOWN)


def test_bad_sources(tmp_path):
    with pytest.raises(Usage, match="SHELFMARK_JOB"):
        S.from_environment({"SHELFMARK_JOB": "1"}, KNOWN)
    with pytest.raises(Usage, match="command line"):
        S.effective(KNOWN, command_line={"x": "1"})
    path = tmp_path / "settings"
    path.write_text("jobs = 5")
    path.chmod(0o600)
    assert S.read_file(str(path), KNOWN) == {"jobs": "5"}
    path.chmod(0o620)
    with pytest.raises(Usage, match="others may write"):
        S.read_file(str(path), KNOWN)


def test_scopes_typed_keys_and_groups():
    defaults = {"compress": "zstd", "quick": "no", "keep": "no", "newer": "no", "always": "yes", "passphrase-file": "", "workers": "4"}
    file = {"compress": "xz", "keep": "yes", "workers": "2"}
    shown = S.effective(defaults, file, {"quick": "yes"}, {}, rules=S.RULES)
    assert {k: s.value for k, s in shown.items()} == defaults | file | {"quick": "yes"}
    of = lambda op, typed={}: {k: s.source for k, s in S.effective(defaults, file, {"quick": "yes"}, typed, op, S.RULES).items() if s.source != "default"}
    assert of("list") == {"workers": "file"} and of("create") == {"compress": "file", "workers": "file"} and of("verify") == {"quick": "environment", "workers": "file"}
    assert of("extract") == {"keep": "file", "workers": "file"} and of("extract", {"newer": "yes"}) == {"newer": "command line", "workers": "file"}
    with pytest.raises(Usage, match="typed"):
        S.effective(defaults, {"passphrase-file": "x"}, rules=S.RULES)
    assert S.effective(defaults, {}, {}, {"passphrase-file": "x"}, rules=S.RULES)["passphrase-file"].value == "x"
    assert [S.boolean(t) for t in ("Yes", "off", "1")] == [True, False, True]
    with pytest.raises(Usage):
        S.boolean("maybe")

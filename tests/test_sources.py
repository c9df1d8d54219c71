import subprocess

import pytest
from conftest import KEY, LOG, git
from pyspark.sql import functions as F
from stratalog.operators import files as fs, history as h, hygiene as hy, risk, secret_rules as sr
from stratalog.sources import git as g, resolve
from stratalog.sources.ignore import IgnoreMatcher

NOW = 1617408000 + 28 * 86400  # 2021-05-01


def load(spark, kind, root, **options):
    g.register(spark)
    r = spark.read.format(kind).option("paths", f"orchard={root}")
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def test_commits_and_contributors(spark, history):
    c = load(spark, "git_commits", history)
    rows = c.orderBy("seq").collect()
    assert [r.subject for r in rows] == [m.split("\n")[0] for _, _, m, _, _ in reversed(LOG)]
    assert rows[2].body == "why\nand how"
    assert sorted((f.path, f.insertions, f.deletions) for f in rows[5].files) == [("config.ini", 1, 0), ("tools/prune.py", 3, 0)]
    changes = g.file_changes(c)
    who = h.contributors(c, changes).orderBy("rank").collect()
    assert [(r.name, r.commits) for r in who] == [("Dana", 4), ("Eli", 2), ("Fay", 1)]
    assert who[0].first_seen[:10] == "2021-03-01" and who[0].last_seen[:10] == "2021-04-03"
    assert h.bus_factor(c).head().bus_factor == 1
    grid = h.activity_grid(c)
    assert grid.agg(F.sum("commits")).head()[0] == 7
    assert tuple(grid.filter("peak").select("weekday", "hour", "commits").head()) == (0, 9, 1)
    top = h.hotspots(changes).filter("rank = 1").head()
    assert (top.path, top.commits) == ("tools/prune.py", 4)
    card = h.repo_card(c, NOW).head()
    assert (card.born[:10], card["last"][:10], card.commits, card.contributors, card.last_words) == ("2021-03-01", "2021-04-03", 7, 3, "fix: drop pruning")


def test_ranges_tags_and_branches(spark, history):
    refs = load(spark, "git_refs", history)
    branches = {r.name: r for r in refs.filter("kind = 'branch'").collect()}
    assert set(branches) == {"main", "graft"} and branches["main"].merged and not branches["graft"].merged
    aged = {r.name: r.stale for r in hy.branch_hygiene(refs.filter("kind = 'branch'"), NOW, 20).collect()}
    assert aged == {"main": True, "graft": False}
    c = load(spark, "git_commits", history)
    tags = refs.filter("kind = 'tag'").select("repo", "name", "sha")
    assert {r.release for r in h.release_history(c, tags).collect()} == {"v1.0", "Unreleased"}
    draft = h.changelog_draft(c, tags).head()
    assert (draft.commits, draft.bump) == (3, "patch")
    inside, before = load(spark, "git_commits", history, ref="v1.0..graft"), load(spark, "git_commits", history, ref="v1.0")
    out = h.compare(inside, g.file_changes(inside), before).head()
    assert (out.commits, out.contributors, out.new_contributors) == (4, 3, "Fay,Gus")
    assert {(r.name, r.is_new) for r in h.compare_contributors(inside, before).collect()} == {("Dana", False), ("Fay", True), ("Gus", True)}
    assert [r.subject for r in load(spark, "git_commits", history, needle="TREES").orderBy("seq").collect()] == ["fix: drop pruning", "feat: count trees"]


def test_working_tree_events_blobs(spark, history):
    files = load(spark, "tree_files", history, content="true", blob="true")
    rows = {r.path: r for r in files.collect()}
    assert set(rows) == {"config.ini", "harvest.txt", "notes/ground.md", "plan.txt", "tools/saw.py"}
    assert rows["harvest.txt"].content is None and rows["harvest.txt"].size > 1_000_000
    assert {r.path for r in load(spark, "tree_dirs", history).collect()} == {"notes", "tools"}
    changes = g.file_changes(load(spark, "git_commits", history))
    stale = hy.stale_files(changes, files, NOW, 1).head()
    assert (stale.path, stale.age_days) == ("plan.txt", 60)
    events = load(spark, "git_file_events", history)
    dead = {r.path: r for r in hy.deleted_paths(events, files).collect()}
    assert set(dead) == {"tools/prune.py", "notes/soil.md"} and dead["tools/prune.py"].author == "Dana"
    assert g.restore_deleted(str(history), "tools/prune.py").endswith(b"return 0\n")
    blame = load(spark, "git_blame", history, paths_list="notes/ground.md\nnone.txt\nplan.txt")
    # lines keep their author over a rename
    assert {(r.repo, r.path, r.author) for r in blame.collect()} == {("orchard", "notes/ground.md", "Eli"), ("orchard", "plan.txt", "Dana")}
    names = load(spark, "git_names", history, paths_list="notes/ground.md")
    assert [(r.name, r.place) for r in names.collect()] == [("notes/soil.md", 0)]
    body = {r.path: r.content for r in load(spark, "git_contents", history, ref="v1.0", paths_list="notes/soil.md\nno such\nplan.txt").collect()}
    assert bytes(body["notes/soil.md"]) == b"clay\nsand\n" and body["no such"] is None and bytes(body["plan.txt"]).startswith(b"rows")


def test_large_living_files_are_not_dead(spark, history):
    files = load(spark, "tree_files", history, content="true", blob="true")
    blobs = load(spark, "git_blobs", history)
    dead = fs.dead_blobs(blobs, files)
    assert {r.path for r in dead.collect()} == {"config.ini", "tools/prune.py", "graft.py"}
    assert risk.purge_plan(dead, spark.createDataFrame([], "repo string, path string, line long, rule string, severity string"), 1000).count() == 0
    assert fs.heavy_blobs(dead, 1).head().rank == 1
    with pytest.raises(Exception, match="no blob id"):
        fs.dead_blobs(blobs, files.drop("blob")).count()
    small = load(spark, "git_blobs", history, content="true").filter("content is not null")
    assert small.filter(fs.blob_sha(F.col("content")) != F.col("sha")).count() == 0


def test_secrets_get_the_commit_of_their_blob(spark, history):
    blobs = load(spark, "git_blobs", history, content="true").withColumnRenamed("sha", "blob").withColumn("content", F.col("content").cast("string"))
    introduced = load(spark, "git_blob_commits", history)
    rows = sr.secret_scan(blobs, introduced).collect()
    assert [(r.path, r.rule, r.author_name, r.author_date[:10]) for r in rows] == [("config.ini", "aws-access-key", "Fay", "2021-04-02")] and KEY not in str(rows)
    receipts = {r.path: r.skip_reason for r in sr.scan_receipts(blobs).collect()}
    assert receipts["harvest.txt"] == "no content" and receipts["plan.txt"] is None
    done = blobs.select("repo", "blob")
    assert sr.secret_scan(blobs, introduced, scanned=done).count() == 0


def test_dossier(spark, history):
    changes = g.file_changes(load(spark, "git_commits", history, path="notes/ground.md", follow="true")).withColumn("path", F.lit("notes/ground.md"))
    blame = load(spark, "git_blame", history, path="notes/ground.md")
    names = load(spark, "git_names", history, path="notes/ground.md")
    files = load(spark, "tree_files", history)
    d = h.dossier_of(changes, ["notes/ground.md"], files=files, blame=blame, former=names, now=NOW).head()
    assert (d.exists, d.created[:10], d.commits, d.authors, d.former_names, d.lines) == (True, "2021-03-05", 2, 2, "notes/soil.md", 2)
    with pytest.raises(KeyError, match="never.txt"):
        h.dossier_of(changes, ["never.txt"], files=files)


def test_repositories_of_one_folder_name(spark, history, tmp_path):
    other = tmp_path / "orchard"
    other.mkdir()
    git(other, "init", "-q")
    (other / "plan.txt").write_text("else\n")
    git(other, "add", "-A")
    git(other, "commit", "-q", "-m", "one")
    g.register(spark)
    c = spark.read.format("git_commits").option("paths", f"{history},{other}").load()
    assert {r.repo: r.n for r in c.groupBy("repo").agg(F.count("*").alias("n")).collect()} == {str(history): 7, str(other): 1}
    with pytest.raises(ValueError):
        g.named_roots(f"a={history},a={other}")


def test_plumbing_and_cache(spark, history, tmp_path):
    root = str(history)
    assert g.is_repo(root) and not g.is_repo(str(tmp_path)) and g.version().startswith("git version")
    assert g.current_branch(root) == "main" and g.head_sha(root) == git(history, "rev-parse", "HEAD").strip() and not g.is_shallow(root)
    with pytest.raises(RuntimeError):
        list(g.git(root, "log", "no-such-ref"))
    assert resolve.resolve(root, tmp_path).kind == "local"
    with pytest.raises(FileNotFoundError):
        resolve.resolve(str(tmp_path / "none"), tmp_path)
    cache = tmp_path / "cache"
    far = resolve.resolve(f"file://{history}", cache)
    assert far.kind == "remote" and g.is_shallow(far.path)
    again = resolve.resolve(f"file://{history}", cache, depth=None)
    assert again.path == far.path and not g.is_shallow(far.path)
    assert [n for n, size, _ in resolve.cached(cache) if size > 0] == [far.path.rsplit("/", 1)[-1]]
    assert {name: ok for name, ok, _ in resolve.doctor(cache)}["git"]
    assert resolve.purge(cache) and not list(cache.iterdir())


def test_ignore_rules_agree_with_git(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    lines = ["*.log", "build/", "!keep.log", "secrets/**", "/top.txt", "a/**/z", "d?c/*.tmp", "[ab].x", "\\#odd"]
    (tmp_path / ".gitignore").write_text("\n".join(lines) + "\n")
    paths = ["x.log", "keep.log", "sub/y.log", "build/out", "sub/build/out", "secrets/k", "top.txt", "sub/top.txt", "a/z", "a/b/c/z", "doc/n.tmp",
             "a.x", "c.x", "#odd", "src/main.py", "build"]
    got = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "--stdin"], input="\n".join(paths), capture_output=True, text=True).stdout.split("\n")
    m = IgnoreMatcher(lines)
    assert {p for p in paths if m.ignored(p)} == {x.strip('"') for x in got if x}

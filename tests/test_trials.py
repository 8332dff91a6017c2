import json

from markweave.plans import trials
from markweave.streaming import resume


def counting(folder):
    """A generator that scores by the prompt's length, fails its first answer now and then, and leaves a file for every batch."""

    def make():
        class Stub:
            seen: dict = {}

            def generate(self, asked, parameters, n=1):
                import os
                import uuid

                with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                    f.write(str(len(asked)))
                out = []
                for prompt in asked:
                    times = self.seen[prompt] = self.seen.get(prompt, 0) + 1
                    out.append(["broken" if len(prompt) % 3 == 0 and times == 1 else json.dumps({"predicted_overall": 1 + len(prompt) % 5, "reasoning": "because"})] * n)
                return out

        return Stub()

    return make


def asked(folder):
    return sum(int(p.read_text()) for p in folder.iterdir())


def test_pilot_and_robustness(spark, sf, tmp_path):
    wide = spark.read.parquet(f"{sf}/rater_essay_wide.parquet")
    calls = tmp_path / "calls"
    calls.mkdir()
    run = lambda: trials.run_pilot(wide, counting(str(calls)), str(tmp_path / "pilot"), (1, 3, 5), 12, 7, max_model_len=3000, batch_size=4)
    got = run()
    records = got["records"].collect()
    assert len(records) == 36 and {r.K for r in records} == {1, 3, 5} and len({r.target_id for r in records}) == 12
    for r in records:
        assert len(r.history_ids) == len(r.history_rater_ids) == r.K and r.target_id not in r.history_ids and set(r.history_rater_ids) == {r.rater_id}
        if not r.context_fit:
            assert r.parse_error == "context overflow" and r.retry_count == 0 and not r.parse_success and r.raw_model_output == ""
        else:
            assert r.parse_success and r.retry_count == (len(r.prompt) % 3 == 0) and len(r.raw_model_output_attempts) == r.retry_count + 1 and r.inference_time_seconds > 0
    by = {(r.target_id, r.K): r.history_ids for r in records}
    assert all(by[t, 5][:3] == by[t, 3] and by[t, 3][:1] == by[t, 1] for t, k in by if k == 5)
    assert {r.K: r.n for r in got["k_summary"].collect()} == {k: sum(r.parse_success for r in records if r.K == k) for k in (1, 3, 5)}
    meta = json.loads((tmp_path / "pilot/experiment_metadata.json").read_text())
    assert meta["seed"] == 7 and meta["sizes"] == [1, 3, 5] and meta["git_commit"]
    n = asked(calls)
    assert n == sum(len(r.raw_model_output_attempts) for r in records)
    run()
    assert asked(calls) == n  # nothing is asked twice
    again = trials.run_robustness(wide, counting(str(calls)), str(tmp_path / "more"), str(tmp_path / "pilot"), (7, 8), 7, max_model_len=100_000)
    rows = again["records"].collect()
    assert {(r.seed, r.K) for r in rows} == {(7, 3), (7, 5), (8, 3), (8, 5)} and len(rows) == 48 and all(r.reused_from_base_pilot == (r.seed == 7) for r in rows)
    assert {(r.seed, r.K) for r in again["seed_summary"].collect()} == {(r.seed, r.K) for r in rows if r.parse_success}
    # An interrupted run: one partition is lost, and only that one is done again.
    import shutil

    before = asked(calls)
    shutil.rmtree(tmp_path / "more/records/seed=8/K=5")
    assert resume.completed(spark, str(tmp_path / "more/records"), again["records"].schema).count() == 12
    again = trials.run_robustness(wide, counting(str(calls)), str(tmp_path / "more"), str(tmp_path / "pilot"), (7, 8), 7, max_model_len=100_000)
    assert again["records"].count() == 48 and asked(calls) == before + 12

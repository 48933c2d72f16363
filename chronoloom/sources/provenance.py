"""Where a run's numbers come from: the code's state, the constants that shape them, the seeds in force."""

from __future__ import annotations

import inspect
import json
import subprocess

from chronoloom.sources.sinks import canonical_hash


def git_state(root: str = ".") -> dict[str, str | bool | None]:
    """commit and dirty of a checkout; nulls outside one or without git."""

    def ask(*words: str) -> str | None:
        try:
            got = subprocess.run(["git", "-C", root, *words], capture_output=True, text=True, timeout=10)
        except (OSError, subprocess.SubprocessError):
            return None
        return got.stdout.strip() if got.returncode == 0 else None

    changed = ask("status", "--porcelain")
    return {"commit": ask("rev-parse", "HEAD"), "dirty": None if changed is None else bool(changed)}


def _defaults(f, *names: str) -> dict:
    found = inspect.signature(f).parameters
    return {n: found[n].default for n in names}


def constants() -> dict[str, dict]:
    """Constants by part, read from the modules that own them."""
    from chronoloom.functions import dsp
    from chronoloom.operators import binding, robust

    return {
        "ear": {"sample_rate": dsp.RATE, "fft": dsp.FFT, "log_bins": dsp.LOG_BINS, "mad_to_sigma": robust.MAD_TO_SIGMA},
        "eye": {"mad_to_sigma": robust.MAD_TO_SIGMA, **_defaults(robust.global_threshold, "k")},
        "binder": _defaults(binding.shift_null, "n_shifts", "seed", "tight_ms", "margin_ms"),
    }


def provenance(config: dict, root: str = ".") -> dict[str, str | bool | None]:
    """One flat record for a run's report: the code's state, and constants, seeds and config as JSON and hash."""
    return {**git_state(root), "constants": json.dumps(constants(), sort_keys=True), "config": json.dumps(config, sort_keys=True, default=str), "config_hash": canonical_hash(config)}

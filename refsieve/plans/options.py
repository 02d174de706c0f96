"""Options of a run: checked and clamped values, and what of them may be shown."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: The flag whose value is a secret, the most workers and retries.
SECRET_FLAG = "--ncbi-api-key"
MOST_WORKERS, MOST_RETRIES = 8, 3


@dataclass(frozen=True)
class Options:
    timeout: float = 30.0
    cache_days: int = 30
    threshold: float = 0.2
    workers: int = 4
    retries: int = 1
    max_entries: int = 0
    pmids: tuple[str, ...] = ()
    claims: str | None = None
    title: str | None = None
    journal: str | None = None
    year: str | None = None
    warnings: tuple[str, ...] = field(default=())

    def checked(self) -> Options:
        """These options with clamped values and warnings; wrong ones raise ValueError."""
        faults = {
            "timeout must be above 0": self.timeout <= 0,
            "cache_days must be 0 or more": self.cache_days < 0,
            "threshold must be from 0 to 1": not 0 <= self.threshold <= 1,
            "workers must be 1 or more": self.workers < 1,
            "retries must be 0 or more": self.retries < 0,
            "max_entries must be 0 (no limit) or more": self.max_entries < 0,
            "title cannot be combined with claims": bool(self.title and self.claims),
            "title applies to exactly one PMID": bool(self.title) and len(self.pmids) != 1,
            "journal and year go with a title": not self.title and bool(self.journal or self.year),
        }
        if wrong := [text for text, is_so in faults.items() if is_so]:
            raise ValueError("; ".join(wrong))
        clamped = {name: most for name, most in (("workers", MOST_WORKERS), ("retries", MOST_RETRIES)) if getattr(self, name) > most}
        return replace(self, **clamped, warnings=tuple(f"{name} clamped to {most}" for name, most in clamped.items()))

    def direct_claim(self) -> tuple[str, str, str | None, str | None] | None:
        """(pmid, title, journal, year) of a claim given on the command line."""
        return (self.pmids[0], self.title, self.journal, self.year) if self.title else None


def redacted_arguments(arguments: list[str]) -> list[str]:
    """Arguments with the value of the secret flag masked, however the flag is shortened."""
    out, masked = [], False
    for argument in arguments:
        flag, given, _ = argument.partition("=")
        secret = not masked and flag.startswith("--") and SECRET_FLAG.startswith(flag)
        out.append("***" if masked else f"{flag}=***" if secret and given else argument)
        masked = secret and not given
    return out


def masked_proxy(url: str) -> str:
    """A proxy's address without its password."""
    head, at, host = url.rpartition("@")
    if not at:
        return url
    scheme, slashes, user = head.rpartition("//")
    return f"{scheme}{slashes}{user.partition(':')[0]}:****@{host}"

"""Settings of the engine, with the values that published results were made with."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

log = logging.getLogger("kinfold")

# Placeholder social security numbers that never identify a person.
PLACEHOLDER_SSNS = (
    "000000000", "111111111", "222222222", "333333333", "444444444",
    "555555555", "666666666", "777777777", "888888888", "999999999",
    "123456789", "987654321", "012345678",
)

# Systems that outrank all others for identity fields, best first; `local_employees` stands for the site's own system.
AUTHORITY = ("verified", "nppes", "local_employees", "state_license", "scraped_license")

# Status codes of credential matches.
QUALIFYING_CODES = (20, 30, 40, 45, 65, 70, 80, 85, 90)
ROLLUP_EXCLUDED_CODES = (10, 100, 85, 80)

#: Tiers of the batch path in order, and that of licences for records that come one by one: name, confidence. The position makes part of new identities' ids.
TIERS = (("ssn_hash", 0.99), ("npi", 0.99), ("upin", 0.99), ("dea_number", 0.99), ("name_dob", 0.95), ("new", 1.0), ("license_state", 0.99))
TIER_NAMES = tuple(name for name, _ in TIERS)

SURVIVING_FIELDS = ("first_name", "middle_name", "last_name", "name_suffix", "date_of_birth", "ssn_hash", "npi", "upin", "dea_number")
JSON_COLUMNS = ("identifiers", "addresses", "licenses", "credentials", "exclusions", "accounts", "aliases", "source_records", "resolutions")


@dataclass(frozen=True)
class Weights:
    """Contributions of the probabilistic signals. `provider_type` has no column to read and never fires."""

    name: float = 0.45
    dob: float = 0.20
    address: float = 0.15
    exclusion: float = 0.07
    zip: float = 0.05
    provider_type: float = 0.08

    @property
    def reachable(self) -> float:
        return round(self.name + self.dob + self.address + self.exclusion + self.zip, 4)


@dataclass(frozen=True)
class ResolutionConfig:
    placeholders: tuple[str, ...] = PLACEHOLDER_SSNS
    ssn_key: str | None = None
    most_people_per_ssn: int = 3
    auto_merge_at: float = 0.92
    review_floor: float = 0.75
    block_cap: int = 2000
    weights: Weights = field(default_factory=Weights)
    authority: tuple[str, ...] = AUTHORITY
    qualifying_codes: tuple[int, ...] = QUALIFYING_CODES
    rollup_excluded_codes: tuple[int, ...] = ROLLUP_EXCLUDED_CODES
    #: Whether a credential without a status code is rolled up.
    keep_null_codes: bool = True
    most_links: int = 10_000
    most_json_bytes: int = 2_097_152

    def confidence(self, tier: str) -> float:
        return dict(TIERS)[tier]

    def warnings(self) -> list[str]:
        """What is inconsistent in the settings; logged when a pipeline starts."""
        out = []
        if self.weights.reachable <= self.auto_merge_at:
            out.append(f"probabilistic weights reach {self.weights.reachable}, auto_merge_at is {self.auto_merge_at}: only perfect scores merge automatically")
        for text in out:
            log.warning(text)
        return out

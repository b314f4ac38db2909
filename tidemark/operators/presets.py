"""Named choices of feature columns, as data: what a column's lower-case name must and must not hold."""

from __future__ import annotations

BLOCKS = ("base_", "role_", "phase_", "rpc_", "proto_", "flow_")
WALLET = ("wallet_vendor", "walletconnect", "rpc_provider", "rpc_")
SITE = ("wallet_vendor", "first_party", "first_party_site", "static_to_first_party", "third_party_static", "delayed_static", "analytics_ads", "har_")
#: Presets and pools: with (one of these parts), without (none of them), prefixes (one of them). Fixed values.
PRESETS: dict[str, dict[str, tuple[str, ...]]] = {
    "all": {},
    "no_wallet_vendor": {"without": ("wallet_vendor",)},
    "traffic_family": {"without": SITE},
    "wallet_agnostic": {"without": WALLET},
    "strict_wallet_agnostic": {"without": (*WALLET, "unknown")},
    "wallet_rpc_backend": {"with": ("walletconnect", "rpc_", "rpc_provider", "backend", "udp443")},
    "postconnect_no_site_static": {"without": ("first_party_site", "static_to_first_party", "har_", "quality_", "pcap_"), "prefixes": BLOCKS},
    "timing_core": {"with": ("delay", "dur", "iat", "burst", "flow_", "rate", "active", "n_pkts", "bytes"), "prefixes": BLOCKS},
}


def columns(names: list[str], preset: str) -> list[str]:
    """The names that a preset keeps, in order; ``_no_rpc`` after a preset's name takes out rpc_ columns too."""
    base = preset.removesuffix("_no_rpc")
    rule = PRESETS[base] if base in PRESETS else PRESETS[preset]
    gone = (*rule.get("without", ()), *(("rpc_",) if preset.endswith("_no_rpc") else ()))

    def keep(name: str) -> bool:
        low = name.lower()
        return (not rule.get("with") or any(x in low for x in rule["with"])) and not any(x in low for x in gone) and (not rule.get("prefixes") or low.startswith(rule["prefixes"]))

    return [n for n in names if keep(n)]


def scenarios(name_rates: list[float], dns_rates: list[float]) -> list[dict[str, float]]:
    """Every pair of a rate of hidden server names and one of hidden DNS answers, in order and once."""
    seen: dict[tuple[float, float], None] = {(a, b): None for a in name_rates for b in dns_rates}
    return [{"sni": a, "dns": b} for a, b in seen]


def parse_grid(text: str) -> list[float]:
    """Different numbers from 0 to 1 of a comma-separated list, in order; anything else is an error."""
    out = list(dict.fromkeys(float(x) for x in text.split(",") if x.strip()))
    if not out or any(not 0 <= x <= 1 for x in out):
        raise ValueError(f"weights must be from 0 to 1: {text!r}")
    return out

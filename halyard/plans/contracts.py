"""Contracts: what a dataset is keyed by and measures; they drive parsing, typing, rules, merging and reconciliation."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Lineage of every stored row; the first six are required.
LINEAGE = {
    "_source_name": "string", "_source_file": "string", "_source_url": "string", "_source_hash": "string", "_ingestion_timestamp": "timestamp", "_run_id": "string",
    "_source_version": "string", "_source_created_at": "string",
}
REQUIRED_LINEAGE = list(LINEAGE)[:6]


@dataclass(frozen=True)
class Contract:
    dataset: str
    source_name: str
    #: column -> type
    keys: dict[str, str]
    measures: dict[str, str]
    #: measures and attributes that must be there
    required: tuple[str, ...] = ()
    attributes: dict[str, str] = field(default_factory=dict)
    #: key -> (least, most)
    domains: dict[str, tuple[int, int]] = field(default_factory=dict)
    #: column -> raw column of the parsed frame
    raw: dict[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> dict[str, str]:
        return {**self.keys, **self.measures, **self.attributes}

    def typing(self) -> dict[str, tuple[str, str]]:
        return {name: (self.raw.get(name, f"{name}_raw"), kind) for name, kind in self.columns.items()}

    def ddl(self) -> str:
        needed = [*self.keys, *self.required, *REQUIRED_LINEAGE]
        return ", ".join(f"{c} {t.upper()}{' NOT NULL' if c in needed else ''}" for c, t in {**self.columns, **LINEAGE}.items())


#: The columns of a batch's status, and what the results call those with another name.
STATUS = ["source_name", "dataset_name", "rule_id", "rule_category", "rule_outcome", "execution_status", "records_checked", "records_failed", "observed_value", "expected_value", "evaluated_at", "details", "run_id"]
CALLED = {"rule_outcome": "severity", "execution_status": "status", "evaluated_at": "execution_timestamp"}
#: The price components, under the names that facts, events and functions give them.
PRICES = ("zonal_price_capped_cad_per_mwh", "loss_price_capped_cad_per_mwh", "congestion_price_capped_cad_per_mwh")
_HOUR, _MW, _PRICE = {"market_date": "date", "hour_ending": "int"}, "decimal(18,3)", "decimal(18,2)"
_PRICES = dict.fromkeys(PRICES, _PRICE)

CONTRACTS = {
    c.dataset: c
    for c in (
        Contract("market_demand_hourly", "demand", _HOUR, {"market_demand_mw": _MW, "ontario_demand_mw": _MW}, ("market_demand_mw", "ontario_demand_mw"), domains={"hour_ending": (1, 24)},
                 raw={"market_date": "date_raw", "hour_ending": "hour_raw", "market_demand_mw": "market_demand_raw", "ontario_demand_mw": "ontario_demand_raw"}),
        Contract("zonal_demand_hourly", "zonal_demand", _HOUR | {"zone": "string"}, {"zonal_demand_mw": _MW}, ("zonal_demand_mw",), domains={"hour_ending": (1, 24)}),
        Contract("generation_hourly", "generation", _HOUR | {"fuel_type": "string"}, {"output_mwh": _MW}, ("output_quality_code",), {"output_quality_code": "int"}, {"hour_ending": (1, 24)},
                 {"market_date": "date_raw", "hour_ending": "hour_raw", "fuel_type": "fuel_type_raw", "output_mwh": "output_raw", "output_quality_code": "output_quality_raw"}),
        Contract("day_ahead_price_hourly", "day_ahead_price", _HOUR, _PRICES, (), {"_source_flag": "string"}, {"hour_ending": (1, 24)},
                 dict(zip(PRICES, ("zonal_price_raw", "loss_price_raw", "congestion_price_raw"), strict=True)) | {"_source_flag": "source_flag_raw"}),
        Contract("realtime_price_5min", "realtime_price", {"delivery_date": "date", "delivery_hour": "int", "interval": "int"}, _PRICES, (), {"_source_flag": "string"}, {"delivery_hour": (1, 24), "interval": (1, 12)},
                 dict(zip(PRICES, ("lmp_cap_raw", "loss_price_cap_raw", "cong_price_cap_raw"), strict=True)) | {"_source_flag": "flag_raw"}),
    )
}

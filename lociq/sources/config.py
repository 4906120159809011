"""Dataset configuration: YAML to plain values on the driver. No data passes here."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

AUTOSOMES = tuple(str(i) for i in range(1, 23))


@dataclass
class Config:
    dataset: str
    section: str
    tissue: str  # "germline" or "somatic"
    chrom_prefix: str = ""
    build: str = "GRCh38"
    paths: dict[str, str] = field(default_factory=dict)
    spatial: dict = field(default_factory=dict)
    quality: dict = field(default_factory=dict)
    classifier: dict = field(default_factory=dict)
    panel: dict = field(default_factory=dict)

    @property
    def regions(self) -> list[str]:
        return [f"{self.chrom_prefix}{c}" for c in AUTOSOMES]

    @property
    def is_germline(self) -> bool:
        return self.tissue == "germline"

    @property
    def is_somatic(self) -> bool:
        return self.tissue == "somatic"

    @property
    def quality_text(self) -> str:
        """Depth, quality and score limits as used in names of outputs."""
        return "_".join(f"{k}{self.quality[k]}" for k in sorted(self.quality))

    def panel_path(self, chrom: str) -> str:
        """Panel file of a chromosome; builds before 38 name it by the bare number."""
        bare = chrom.removeprefix("chr")
        return self.panel["pattern"].format(chrom=bare if self.build in ("hg19", "GRCh37") else f"chr{bare}")


def _filled(value, names: dict[str, str]):
    """``{name}`` placeholders replaced, in texts at any depth; unknown ones stay."""
    if isinstance(value, str):
        for k, v in names.items():
            value = value.replace("{" + k + "}", v)
        return value
    if isinstance(value, dict):
        return {k: _filled(v, names) for k, v in value.items()}
    return [_filled(v, names) for v in value] if isinstance(value, list) else value


def from_dict(raw: dict, dataset: str, section: str | None = None) -> Config:
    """Resolve one section of a dataset; the first section if none is named. A section's own spatial settings win."""
    ids = [str(s) for s in raw["sections"]["ids"]]
    section = ids[0] if section is None else str(section)
    if section not in ids:
        raise ValueError(f"{dataset} has no section {section}; it has {', '.join(ids)}")
    dataset = dataset.upper()
    names = {"dataset": dataset, "section": section, "section_id": section}
    names |= {k: v for k, v in _filled(raw.get("paths", {}), names).items() if isinstance(v, str)}
    spatial = dict(raw.get("spatial", {}))
    spatial |= (spatial.pop("section_overrides", None) or {}).get(section, {})
    reference = raw.get("reference", {})
    return Config(
        dataset=dataset, section=section, tissue=raw.get("tissue", raw.get("tissue_type", "germline")), chrom_prefix=reference.get("chr_prefix") or "", build=reference.get("build", "GRCh38"),
        paths=_filled(raw.get("paths", {}) | raw.get("output", {}) | raw.get("input", {}), names), spatial=_filled(spatial, names), quality=raw.get("quality_filter") or {},
        classifier=raw.get("classifier") or {}, panel=_filled(raw.get("thousand_genomes") or {}, names),
    )


def load(folder: str, dataset: str, section: str | None = None) -> Config:
    import yaml

    return from_dict(yaml.safe_load((Path(folder) / f"{dataset.upper()}.yaml").read_text()), dataset, section)


def all_sections(folder: str, dataset: str) -> list[Config]:
    import yaml

    raw = yaml.safe_load((Path(folder) / f"{dataset.upper()}.yaml").read_text())
    return [from_dict(raw, dataset, s) for s in raw["sections"]["ids"]]

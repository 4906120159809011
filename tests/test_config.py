"""The four datasets of the published analyses: tissue, sections, prefixes and builds."""

import pytest

from lociq.sources import config

#: Dataset, tissue, sections, prefix of chromosome names, build, spot files by section.
DATASETS = [
    ("DLPFC", "germline", ["151507", "151508", "151509", "151510", "151669", "151670", "151671", "151672", "151673", "151674", "151675", "151676"], "", "GRCh38"),
    ("P4_TUMOR", "somatic", ["1", "2"], "chr", "hg19"),
    ("P6_TUMOR", "somatic", ["1", "2"], "chr", "hg19"),
    ("DCIS", "somatic", ["1", "2"], "", "GRCh38"),
]


@pytest.mark.parametrize(("name", "tissue", "sections", "prefix", "build"), DATASETS)
def test_datasets(tmp_path, name, tissue, sections, prefix, build):
    text = f"""
tissue_type: {tissue}
sections: {{ids: [{", ".join(f'"{s}"' for s in sections)}]}}
reference: {{fasta: /ref/genome.fa, chr_prefix: "{prefix}", build: {build}}}
paths: {{project_dir: /data/project}}
input: {{bam_pattern: "rep{{section_id}}/split/*.bam"}}
output: {{dir_pattern: "data/{{dataset}}/{{section_id}}"}}
spatial: {{dir: "/data/{{section_id}}/spatial"}}
quality_filter: {{baseQ: 0, mapQ: 0}}
thousand_genomes: {{pattern: "{{project_dir}}/panel/{{chrom}}.vcf.gz"}}
"""
    (tmp_path / f"{name}.yaml").write_text(text)
    first = config.load(str(tmp_path), name.lower())
    assert (first.tissue, first.chrom_prefix, first.build, first.section) == (tissue, prefix, build, sections[0])
    assert first.is_germline == (tissue == "germline") and first.is_somatic == (tissue == "somatic")
    assert first.regions == [f"{prefix}{i}" for i in range(1, 23)]
    assert first.quality_text == "baseQ0_mapQ0"
    every = config.all_sections(str(tmp_path), name)
    assert [c.section for c in every] == sections
    for c in every:
        assert c.paths["dir_pattern"] == f"data/{name}/{c.section}" and c.paths["bam_pattern"] == f"rep{c.section}/split/*.bam"
        assert c.spatial["dir"] == f"/data/{c.section}/spatial"
    assert first.panel_path(f"{prefix}7") == ("/data/project/panel/7.vcf.gz" if build == "hg19" else "/data/project/panel/chr7.vcf.gz")
    with pytest.raises(ValueError, match="no section"):
        config.load(str(tmp_path), name, "none")

"""Haploom: read-phasing, assembly-graph and corpus analytics as Spark DataFrame operators."""

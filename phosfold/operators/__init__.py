"""Operators on tables of sites, samples, networks and kinases, all in long form.

raw (accession, site, sample, value) -> evidence (sample, accession, site) -> enrichment
(network_id, kinase, sample, rep, p) -> activities (sample, kinase, p, fpr).
"""

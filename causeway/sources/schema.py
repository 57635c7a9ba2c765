"""Schemas of the documents that are read."""

from __future__ import annotations

NODE = "struct<label:string,name:string,text:string,node_id:string,node_type:string,evidence:string,explanation:string,source:string>"
EDGE = "struct<source:string,target:string,relation:string,label:string,evidence:string,explanation:string>"
#: Groups of nodes of a graph document.
GROUPS = ["hazard_consequence_node", "entity_nodes", "condition_nodes", "event_nodes"]
EXCLUSIONS = "description string, source_pattern_file string, excluded_cases array<string>"

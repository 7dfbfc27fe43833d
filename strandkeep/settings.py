"""Settings that names and formats depend on."""

#: The word that stands in hash domains, text headers, key prefixes and companion suffixes. Tables written
#: under one namespace are read under the same; set it before use to work with another tool's data.
NAMESPACE = "strandkeep"

"""Fixed values of the exam domain: layouts, renames, recode rules, labels,
defaults, star projections and table definitions.  Data only, no logic."""

"""Labels, rules, templates, mutation specs and text formats."""

"""Signature rules for licences, in order.  Each line: label, keyword that gates it, pattern over lower-cased text.

Earlier lines have higher priority.  ``_`` in a pattern stands for a run of anything but letters and digits.
"""

RULES = r"""
agpl-3.0-only | agpl | agpl_3_0_only
agpl-3.0-or-later | agpl | agpl_3_0_or_later
agpl-3.0 | affero | gnu_affero_general_public_license_(?:v|version_)?3
agpl-3.0-or-later | affero | (?:gnu_)?affero_general_public_license(?:[^.]{0,120})either_version_3(?:[^.]{0,80})any_later_version
agpl-1.0 | affero | (?:gnu_)?affero_general_public_license_(?:v|version_)?1
agpl | affero | (?:gnu_)?affero_general_public_license
agpl-3.0 | agpl | agpl_?v?3(?:_0)?
agpl | agpl | licensed_under_(?:the_)?agpl
lgpl-2.1-or-later | lesser | (?:gnu_)?lesser_general_public_license(?:[^.]{0,120})version_2_1(?:[^.]{0,80})any_later_version
lgpl-3.0-or-later | lesser | (?:gnu_)?lesser_general_public_license(?:[^.]{0,120})version_3(?:[^.]{0,80})any_later_version
lgpl-2.1 | lesser | (?:gnu_)?lesser_general_public_license_(?:v|version_)?2_1
lgpl-3.0 | lesser | (?:gnu_)?lesser_general_public_license_(?:v|version_)?3
lgpl | lesser | (?:gnu_)?lesser_general_public_license
lgpl-2.0-or-later | library | (?:gnu_)?library_general_public_license(?:[^.]{0,120})version_2(?:[^.]{0,80})any_later_version
lgpl-2.0 | library | (?:gnu_)?library_general_public_license
lgpl-2.1 | lgpl | lgpl_?v?2_1
lgpl-3.0 | lgpl | lgpl_?v?3(?:_0)?
lgpl-2.0 | lgpl | lgpl_?v?2(?:_0)?
lgpl | lgpl | licensed_under_(?:the_)?lgpl
gpl-2.0-or-later | general public | (?:gnu_)?general_public_license(?:[^.]{0,120})version_2(?:[^.]{0,80})any_later_version
gpl-3.0-or-later | general public | (?:gnu_)?general_public_license(?:[^.]{0,120})version_3(?:[^.]{0,80})any_later_version
gpl-2.0-only | general public | (?:gnu_)?general_public_license_version_2_only
gpl-3.0-only | general public | (?:gnu_)?general_public_license_version_3_only
gpl-2.0-with-classpath-exception | classpath | (?:gnu_)?general_public_license(?:[^.]{0,200})classpath_exception
gpl-3.0-with-gcc-exception | gcc | (?:gnu_)?general_public_license(?:[^.]{0,200})gcc_runtime_library_exception
gpl-2.0-with-font-exception | font | (?:gnu_)?general_public_license(?:[^.]{0,200})font_exception
gpl-1.0 | general public | (?:gnu_)?general_public_license_(?:v|version_)?1
gpl-2.0 | general public | (?:gnu_)?general_public_license_(?:v|version_)?2
gpl-3.0 | general public | (?:gnu_)?general_public_license_(?:v|version_)?3
gpl-2.0 | gpl | gpl_?v?2(?:_0)?
gpl-3.0 | gpl | gpl_?v?3(?:_0)?
gpl-1.0 | gpl | gpl_?v?1(?:_0)?
gpl | gnu | gnu_(?:general_)?public_licen[sc]e
gpl | gpl | (?:licensed_under|released_under|terms_of)_(?:the_)?(?:gnu_)?gpl
gpl | general public | (?:gnu_)?general_public_license
gfdl-1.1 | documentation | gnu_free_documentation_license_(?:v|version_)?1_1
gfdl-1.2 | documentation | gnu_free_documentation_license_(?:v|version_)?1_2
gfdl-1.3 | documentation | gnu_free_documentation_license_(?:v|version_)?1_3
gfdl | documentation | gnu_free_documentation_license
gfdl | gfdl | gfdl(?:_v?1_[123])?
apache-2.0 | apache | apache_(?:software_)?licen[sc]e_(?:v|version_)?2(?:_0)?
apache-1.1 | apache | apache_(?:software_)?licen[sc]e_(?:v|version_)?1_1
apache-1.0 | apache | apache_(?:software_)?licen[sc]e_(?:v|version_)?1(?:_0)?
apache-2.0 | apache | www_apache_org_licenses_license_2_0
apache-2.0 | apache | licensed_under_(?:the_)?apache_2(?:_0)?
apache-2.0 | apache | apache_2_0
apache | apache | apache_(?:software_)?licen[sc]e
apache-1.1 | developed by the apache | this_product_includes_software_developed_by_the_apache
mit-0 | mit | mit_no_attribution
mit-advertising | mit | mit_license_with_advertising
mit-feh | mit | feh_mit
mit | mit | (?:the_)?mit_licen[sc]e
mit | mit | licensed_under_(?:the_)?mit
mit | mit | opensource_org_licenses_mit
mit | hereby granted | permission_is_hereby_granted_free_of_charge_to_any_person_obtaining_a_copy
mit | expat | expat_licen[sc]e
x11 | x11 | x11_licen[sc]e
x11-distribute-modifications | x_consortium | name_of_the_x_consortium
isc | isc | (?:the_)?isc_licen[sc]e
isc | permission to use | permission_to_use_copy_modify_and_(?:or_)?distribute_this_software_for_any_purpose_with_or_without_fee
0bsd | bsd | (?:zero_clause|0_clause)_bsd
0bsd | 0bsd | 0bsd
bsd-1-clause | bsd | (?:1_clause_bsd|bsd_1_clause)
bsd-2-clause-patent | bsd | bsd_2_clause_plus_patent
bsd-2-clause-views | bsd | bsd_2_clause_with_views
bsd-2-clause | bsd | (?:2_clause_bsd|bsd_2_clause|simplified_bsd|freebsd_licen[sc]e)
bsd-3-clause-clear | bsd | bsd_3_clause_clear
bsd-3-clause-attribution | bsd | bsd_3_clause_attribution
bsd-3-clause-lbnl | bsd | (?:lawrence_berkeley_bsd|bsd_3_clause_lbnl)
bsd-3-clause | bsd | (?:3_clause_bsd|bsd_3_clause|new_bsd|revised_bsd|modified_bsd)
bsd-4-clause-uc | bsd | bsd_4_clause_uc
bsd-4-clause | bsd | (?:4_clause_bsd|bsd_4_clause|original_bsd|old_bsd)
bsd | bsd | bsd_(?:style_)?licen[sc]e
bsd-3-clause | neither the name | neither_the_name_of(?:[^.]{0,120})may_be_used_to_endorse
bsd-4-clause | advertising | all_advertising_materials_mentioning_features
bsd | redistribution | redistribution_and_use_in_source_and_binary_forms
mpl-2.0-no-copyleft-exception | incompatible with | incompatible_with_secondary_licenses
mpl-2.0 | mozilla | mozilla_public_licen[sc]e_(?:v|version_)?2(?:_0)?
mpl-1.1 | mozilla | mozilla_public_licen[sc]e_(?:v|version_)?1_1
mpl-1.0 | mozilla | mozilla_public_licen[sc]e_(?:v|version_)?1(?:_0)?
mpl | mozilla | mozilla_public_licen[sc]e
mpl-2.0 | mpl | mozilla_org_mpl_2_0
mpl-2.0 | mpl | mpl_?v?2(?:_0)?
mpl-1.1 | mpl | mpl_?v?1_1
npl-1.1 | netscape | netscape_public_license_(?:v|version_)?1_1
npl | netscape | netscape_public_license
epl-2.0 | eclipse | eclipse_public_licen[sc]e_(?:v|version_)?2(?:_0)?
epl-1.0 | eclipse | eclipse_public_licen[sc]e_(?:v|version_)?1(?:_0)?
epl | eclipse | eclipse_public_licen[sc]e
epl-2.0 | epl | epl_?v?2(?:_0)?
epl-1.0 | epl | epl_?v?1(?:_0)?
edl-1.0 | eclipse | eclipse_distribution_licen[sc]e
cddl-1.1 | common development | common_development_and_distribution_licen[sc]e_(?:v|version_)?1_1
cddl-1.0 | common development | common_development_and_distribution_licen[sc]e_(?:v|version_)?1(?:_0)?
cddl | common development | common_development_and_distribution_licen[sc]e
cddl | cddl | cddl(?:_v?1(?:_[01])?)?
cpl-1.0 | common public | common_public_licen[sc]e
cpal-1.0 | attribution | common_public_attribution_licen[sc]e
ipl-1.0 | ibm | ibm_public_licen[sc]e
eupl-1.2 | european union | european_union_public_licen[sc]e_(?:v|version_)?1_2
eupl-1.1 | european union | european_union_public_licen[sc]e_(?:v|version_)?1_1
eupl-1.0 | european union | european_union_public_licen[sc]e_(?:v|version_)?1(?:_0)?
eupl | european union | european_union_public_licen[sc]e
eupl-1.2 | eupl | eupl_?v?1_2
eupl-1.1 | eupl | eupl_?v?1_1
cecill-2.1 | cecill | cecill_(?:v|version_)?2_1
cecill-b | cecill | cecill_b
cecill-c | cecill | cecill_c
cecill | cecill | cecill
osl-3.0 | open software | open_software_licen[sc]e_(?:v|version_)?3(?:_0)?
osl-2.1 | open software | open_software_licen[sc]e_(?:v|version_)?2_1
osl | open software | open_software_licen[sc]e
afl-3.0 | academic free | academic_free_licen[sc]e_(?:v|version_)?3(?:_0)?
afl-2.1 | academic free | academic_free_licen[sc]e_(?:v|version_)?2_1
afl | academic free | academic_free_licen[sc]e
artistic-2.0 | artistic | artistic_licen[sc]e_(?:v|version_)?2(?:_0)?
artistic-1.0-perl | artistic | artistic_licen[sc]e_1_0_perl
artistic-1.0 | artistic | artistic_licen[sc]e_(?:v|version_)?1(?:_0)?
artistic | artistic | artistic_licen[sc]e
perl | perl | same_terms_as_perl
clartistic | clarified | clarified_artistic_licen[sc]e
bsl-1.0 | boost | boost_software_licen[sc]e
bsl-1.0 | boost | boost_org_license_1_0
busl-1.1 | business source | business_source_licen[sc]e_1_1
busl | business source | business_source_licen[sc]e
sspl-1.0 | server side | server_side_public_licen[sc]e
elastic-2.0 | elastic | elastic_licen[sc]e_(?:v|version_)?2(?:_0)?
elastic | elastic | elastic_licen[sc]e
commons-clause | commons clause | commons_clause
polyform-noncommercial-1.0.0 | polyform | polyform_noncommercial_licen[sc]e
polyform-small-business-1.0.0 | polyform | polyform_small_business_licen[sc]e
polyform-shield-1.0.0 | polyform | polyform_shield_licen[sc]e
polyform-strict-1.0.0 | polyform | polyform_strict_licen[sc]e
parity-7.0.0 | parity | parity_public_licen[sc]e_7
parity-6.0.0 | parity | parity_public_licen[sc]e_6
cc0-1.0 | cc0 | cc0(?:_1_0)?
cc0-1.0 | creative commons | creative_commons_zero
cc-by-nc-nd-4.0 | creative commons | creative_commons_attribution_non_?commercial_no_?deriv\w+_4
cc-by-nc-nd-3.0 | creative commons | creative_commons_attribution_non_?commercial_no_?deriv\w+_3
cc-by-nc-sa-4.0 | creative commons | creative_commons_attribution_non_?commercial_share_?alike_4
cc-by-nc-sa-3.0 | creative commons | creative_commons_attribution_non_?commercial_share_?alike_3
cc-by-nc-4.0 | creative commons | creative_commons_attribution_non_?commercial_4
cc-by-nc-3.0 | creative commons | creative_commons_attribution_non_?commercial_3
cc-by-nd-4.0 | creative commons | creative_commons_attribution_no_?deriv\w+_4
cc-by-nd-3.0 | creative commons | creative_commons_attribution_no_?deriv\w+_3
cc-by-sa-4.0 | creative commons | creative_commons_attribution_share_?alike_4
cc-by-sa-3.0 | creative commons | creative_commons_attribution_share_?alike_3
cc-by-sa-2.5 | creative commons | creative_commons_attribution_share_?alike_2_5
cc-by-sa | creative commons | creative_commons_attribution_share_?alike
cc-by-nc | creative commons | creative_commons_attribution_non_?commercial
cc-by-nd | creative commons | creative_commons_attribution_no_?deriv\w+
cc-by-4.0 | creative commons | creative_commons_attribution_4
cc-by-3.0 | creative commons | creative_commons_attribution_3
cc-by-2.5 | creative commons | creative_commons_attribution_2_5
cc-by-2.0 | creative commons | creative_commons_attribution_2
cc-by | creative commons | creative_commons_attribution
cc-by-nc-nd | cc by | cc_by_nc_nd(?:_[1-4]_[05])?
cc-by-nc-sa | cc by | cc_by_nc_sa(?:_[1-4]_[05])?
cc-by-nc | cc by | cc_by_nc(?:_[1-4]_[05])?
cc-by-nd | cc by | cc_by_nd(?:_[1-4]_[05])?
cc-by-sa | cc by | cc_by_sa(?:_[1-4]_[05])?
cc-by | cc by | cc_by_[1-4]_[05]
cc | creativecommons | creativecommons_org_licenses_by(?:_nc)?(?:_nd|_sa)?_[1-4]_[05]
cc0-1.0 | creativecommons | creativecommons_org_publicdomain_zero
publicdomain-mark | creativecommons | creativecommons_org_publicdomain_mark
unlicense | unlicense | (?:the_)?unlicense
unlicense | unencumbered | free_and_unencumbered_software_released_into_the_public_domain
wtfpl | wtfpl | wtfpl
wtfpl | do what the | do_what_the_f\w+_you_want_to_public_license
public-domain | public domain | (?:placed|released|dedicated)_(?:in|into|to)_the_public_domain
public-domain | public domain | is_in_the_public_domain
pddl-1.0 | public domain | public_domain_dedication_and_licen[sc]e
odbl-1.0 | open database | open_database_licen[sc]e
odc-by-1.0 | open data | open_data_commons_attribution_licen[sc]e
cdla-permissive-2.0 | community data | community_data_licen[sc]e_agreement_permissive_2
cdla-permissive-1.0 | community data | community_data_licen[sc]e_agreement_permissive
cdla-sharing-1.0 | community data | community_data_licen[sc]e_agreement_sharing
ogl-uk-3.0 | open government | open_government_licen[sc]e_(?:v|version_)?3
ogl-uk | open government | open_government_licen[sc]e
etalab-2.0 | etalab | etalab_2_0
etalab-2.0 | licence ouverte | licence_ouverte_open_licence
zlib | zlib | zlib_licen[sc]e
zlib | altered source | altered_source_versions_must_be_plainly_marked
libpng-2.0 | png reference | png_reference_library_licen[sc]e
libpng | libpng | libpng_licen[sc]e
libtiff | libtiff | libtiff_licen[sc]e
ijg | jpeg group | independent_jpeg_group
curl | curl | curl_licen[sc]e
openssl | openssl | openssl_licen[sc]e
openssl | openssl | software_developed_by_the_openssl_project
ssleay | ssleay | (?:original_)?ssleay_licen[sc]e
python-2.0 | python | python_software_foundation_licen[sc]e
psf-2.0 | psf | psf_licen[sc]e_(?:agreement_)?(?:v|version_)?2?
php-3.01 | php | php_licen[sc]e_(?:v|version_)?3_01
php-3.0 | php | php_licen[sc]e(?:_(?:v|version_)?3(?:_0)?)?
ruby | ruby | ruby_licen[sc]e
ruby | ruby | same_terms_as_ruby
vim | vim | vim_licen[sc]e
tcl | tcl | tcl_tk_licen[sc]e
w3c | w3c | w3c_software_(?:notice_and_)?licen[sc]e
w3c-20150513 | w3c | w3c_software_and_document_licen[sc]e
icu | icu | icu_licen[sc]e
unicode-dfs-2016 | unicode | unicode_licen[sc]e_agreement_data_files
unicode-3.0 | unicode | unicode_licen[sc]e_(?:v|version_)?3
ofl-1.1 | open font | (?:sil_)?open_font_licen[sc]e_(?:v|version_)?1_1
ofl-1.0 | open font | (?:sil_)?open_font_licen[sc]e_(?:v|version_)?1_0
ofl | open font | (?:sil_)?open_font_licen[sc]e
ofl-1.1 | ofl | scripts_sil_org_ofl
bitstream-vera | vera | bitstream_vera_fonts_copyright
lppl-1.3c | latex | latex_project_public_licen[sc]e_(?:v|version_)?1_3c
lppl | latex | latex_project_public_licen[sc]e
postgresql | postgresql | postgresql_licen[sc]e
ncsa | ncsa | (?:university_of_illinois_)?ncsa_open_source_licen[sc]e
ncsa | illinois | university_of_illinois_open_source_licen[sc]e
apache-2.0-with-llvm-exception | llvm | apache_licen[sc]e(?:[^.]{0,40})llvm_exceptions?
ms-pl | microsoft | microsoft_public_licen[sc]e
ms-rl | microsoft | microsoft_reciprocal_licen[sc]e
ms-lpl | microsoft | microsoft_limited_public_licen[sc]e
apsl-2.0 | apple | apple_public_source_licen[sc]e_(?:v|version_)?2
apsl | apple | apple_public_source_licen[sc]e
qpl-1.0 | q public | q_public_licen[sc]e
sleepycat | sleepycat | sleepycat_licen[sc]e
sissl | sun industry | sun_industry_standards_source_licen[sc]e
spl-1.0 | sun public | sun_public_licen[sc]e
bcl | binary code | oracle_binary_code_licen[sc]e
upl-1.0 | universal permissive | universal_permissive_licen[sc]e
nasa-1.3 | nasa | nasa_open_source_agreement
ecl-2.0 | educational | educational_community_licen[sc]e_(?:v|version_)?2
ecl | educational | educational_community_licen[sc]e
efl-2.0 | eiffel | eiffel_forum_licen[sc]e
fair | fair | fair_licen[sc]e
ftl | freetype | freetype_(?:project_)?licen[sc]e
hpnd | historical permission | historical_permission_notice_and_disclaimer
intel | intel | intel_open_source_licen[sc]e
json | shall be used for good | shall_be_used_for_good_not_evil
beerware | beer | beer_?ware_licen[sc]e
mulanpsl-2.0 | mulan | mulan_permissive_software_licen[sc]e_(?:v|version_)?2
mulanpsl | mulan | mulan_permissive_software_licen[sc]e
blueoak-1.0.0 | blue oak | blue_oak_model_licen[sc]e
rpl-1.5 | reciprocal public | reciprocal_public_licen[sc]e
simpl-2.0 | simple public | simple_public_licen[sc]e
watcom-1.0 | watcom | sybase_open_watcom_public_licen[sc]e
xfree86-1.1 | xfree86 | xfree86_licen[sc]e
zpl-2.1 | zope | zope_public_licen[sc]e_(?:v|version_)?2_1
zpl | zope | zope_public_licen[sc]e
openrail-m | openrail | (?:creativeml_)?openrail_?\+*_?m
openrail-m | open rail | (?:creativeml_)?open_rail_?\+*_?m
bigscience-rail-1.0 | bigscience | bigscience_rail_licen[sc]e
llama-community | llama | llama_\d?_?\d?_?community_licen[sc]e
gemma-terms | gemma | gemma_terms_of_use
spdx | spdx | spdx_license_identifier_[a-z0-9]+(?:_[a-z0-9]+){0,5}
all-rights-reserved | all rights | all_rights_reserved
proprietary | proprietary | proprietary_and_confidential
proprietary | unauthorized | unauthorized_copying_of_this_file
copyright-notice | copyright | copyright_(?:c_)?(?:19|20)\d\d
"""

#: SPDX identifiers beside the labels above.
SPDX = """
AFL-1.1 AFL-1.2 AFL-2.0 AGPL-1.0-only AGPL-1.0-or-later AML APL-1.0 APSL-1.0 APSL-1.1 APSL-1.2 Artistic-1.0-cl8 BitTorrent-1.0 BitTorrent-1.1 BSD-3-Clause-Modification
BSD-3-Clause-No-Nuclear-License BSD-3-Clause-Open-MPI BSD-4-Clause-Shortened BSD-Protection BSD-Source-Code bzip2-1.0.6 CAL-1.0 CATOSL-1.1 CC-BY-1.0 CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5
CC-BY-NC-ND-1.0 CC-BY-NC-ND-2.0 CC-BY-NC-ND-2.5 CC-BY-NC-SA-1.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.5 CC-BY-ND-1.0 CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-SA-1.0 CC-BY-SA-2.0 CC-PDDC CECILL-1.0
CECILL-1.1 CECILL-2.0 CERN-OHL-1.1 CERN-OHL-1.2 CERN-OHL-P-2.0 CERN-OHL-S-2.0 CERN-OHL-W-2.0 CNRI-Python CUA-OPL-1.0 D-FSL-1.0 ECL-1.0 EFL-1.0 EUDatagrid Entessa FSFAP FSFUL FSFULLR Frameworx-1.0
GFDL-1.1-only GFDL-1.1-or-later GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later HPND-sell-variant Hippocratic-2.1 ImageMagick IJG Info-ZIP IPA JasPer-2.0
LAL-1.2 LAL-1.3 LGPL-2.0-only LGPL-2.1-only LGPL-3.0-only LGPLLR LiLiQ-P-1.1 LiLiQ-R-1.1 LiLiQ-Rplus-1.1 Linux-OpenIB Linux-man-pages-copyleft LPL-1.0 LPL-1.02 LPPL-1.0 LPPL-1.1 LPPL-1.2 LPPL-1.3a
MIT-CMU MIT-Modern-Variant MIT-enna MITNFA MirOS Motosoto MulanPSL-1.0 Multics NAIST-2003 NBPL-1.0 NGPL NIST-PD NLPL Nokia NPL-1.0 NPOSL-3.0 NTP OCLC-2.0 OFL-1.0-RFN OFL-1.1-RFN
OGTSL OLDAP-2.7 OLDAP-2.8 OSET-PL-2.1 OSL-1.0 OSL-1.1 OSL-2.0 PostgreSQL PSF-2.0 Python-2.0.1 RPL-1.1 RPSL-1.0 RSCPL SAX-PD SGI-B-1.0 SGI-B-1.1 SGI-B-2.0 SimPL-2.0 SMLNJ SSH-OpenSSH
TCP-wrappers TMate TORQUE-1.1 UCL-1.0 Unicode-TOU VSL-1.0 W3C-19980720 X11 Xnet XSkat ZPL-1.1 ZPL-2.0 zlib-acknowledgement
"""
